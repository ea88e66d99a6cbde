"""Phrase collocations by Toivonen's sampling method.

A sample of the documents proposes the phrases that are likely to be frequent.
A pass over all documents then counts, exactly, every word, every proposed
phrase and their negative border (the phrases whose two shorter ends are
proposed but which are not). A phrase of the border that turns out to be frequent
is a failure: phrases around it may have gone uncounted. Each failure widens the
proposal, and a further pass counts what that newly admits, until no pass fails.
A phrase of k words can only be frequent if its first and its last k - 1 words
are, so a closed proposal has counted every frequent phrase.

Proposals go to the tasks as bit sets over phrase hashes, one for each phrase
length. A bit set admits every proposed phrase and a few others; those are
counted exactly as well, which costs time and changes no result. What has been
counted is decided by the bits themselves, so no occurrence is counted twice.

Scale: a task cuts its texts into blocks of about ``BLOCK`` bytes (at piece
ends, since no phrase crosses one) and counts a block in arrays. What it counted
is dealt by phrase hash into groups, one row for each group of a block with the
phrases and counts as bytes; Spark brings a group's rows together and a task adds
them up. There are so many groups that one holds about ``GROUP`` occurrences at most, as
the sample tells; a frequent phrase is one entry for each block. A bit set has 16
bits for each proposed phrase of the sample up to ``MOST_BITS`` (32 MB); beyond, it
admits more. Nothing else is sent to the tasks or the driver.

Defined cases: a null text is empty, a null language is ``und`` (one group with
a language of that name); rows that repeat count again; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from hearth.llm.common import map_rows, staged

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: The sample holds one document in so many; a phrase is proposed from so large a share of its expected count there.
SAMPLE, LOWERED = 4, 0.8
BLOCK, GROUP = 4 << 20, 1_000_000
MOST_BITS, LEAST_BITS = 28, 16
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"

COUNTS = StructType([StructField("lang", StringType()), StructField("k", IntegerType()),
                     StructField("phrase", StringType()), StructField("n", LongType())])
#: Counts of one block's phrases of one group: the phrases, each ended by a line end, and 64-bit numbers.
PACKED = StructType([StructField("lang", StringType()), StructField("k", IntegerType()), StructField("grp", IntegerType()),
                     StructField("phrases", BinaryType()), StructField("counts", BinaryType())])
#: Words of 64 bits of a bit set.
BITS = StructType([StructField("k", ByteType()), StructField("slot", IntegerType()), StructField("bits", LongType())])

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word at their end."""
    x = (phrase ^ (phrase >> np.uint64(29))) * _MIX + word
    return (x ^ (x >> np.uint64(32))) * _MIX


class BitSet:
    """2^size bits over hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, np.zeros(1 << (size - 6), np.uint64)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = hashes >> np.uint64(64 - self.size)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot, bit = self.place(hashes)
        return (self.words[slot] & bit) != 0


def _blocks(batches: Iterator[dict[str, pa.Array]], block: int) -> Iterator[tuple[str, bytes]]:
    """Lower-cased texts of one language, joined by line ends, cut at piece ends."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    end = bytes(PIECE_ENDS[:1])
    every = bytes.maketrans(PIECE_ENDS, end * len(PIECE_ENDS))

    def cut(lang: str) -> Iterator[tuple[str, bytes]]:
        text, start = b"\n".join(held.pop(lang)).lower(), 0
        sizes.pop(lang)
        if len(text) > 2 * block:
            ends = text.translate(every)
            while len(text) - start > 2 * block:
                at = ends.rfind(end, start, start + block)
                at = ends.find(end, start + block) if at < 0 else at
                if at < 0:
                    break
                yield lang, text[start:at]
                start = at + 1
        yield lang, text[start:]

    for b in batches:
        for lang, text in zip(b["lang"], b["text"].cast(pa.binary()), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= block:
                yield from cut(lang)
            elif len(sizes) > 16 and sum(sizes.values()) >= 4 * block:
                for name in list(held):
                    yield from cut(name)
    for name in list(held):
        yield from cut(name)


def _tokens(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, each token's word, and whether the next token follows in the same piece."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece[1:] == piece[:-1]


def _count_block(lang: str, text: bytes, old: list[BitSet], new: list[BitSet], most: int,
                 words_too: bool) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(phrase length, phrases, counts, hashes) of a block: all words if ``words_too`` (and their
    number, as length 0), and the phrases of two to ``most`` words that ``new`` admits and ``old`` did not."""
    words, code, follows = _tokens(text)
    if not len(code):
        return
    hashes = _word_hashes(lang, words.to_pylist())
    if words_too:
        yield 0, pa.array([b""], pa.large_binary()), np.array([len(code)]), np.zeros(1, np.uint64)
        yield 1, words, np.bincount(code, minlength=len(words)), hashes
    at = np.arange(len(code))  # starts of the phrases of k - 1 words that may be part of a longer one
    whole = hashes[code]  # their hashes
    counted = np.full(len(code), bool(old))  # whether an earlier pass counted them
    for k in range(2, min(most, len(new) + 1) + 1):
        if k == 2:
            in_new = new[0].holds(hashes)[code]
            in_old = old[0].holds(hashes)[code] if old else np.zeros(len(code), bool)
        else:
            in_new = new[k - 2].holds(whole)
            in_old = old[k - 2].holds(whole) if len(old) > k - 2 else np.zeros(len(whole), bool)
        at, whole, counted = at[in_new], whole[in_new], counted[in_new] & in_old[in_new]
        first = np.flatnonzero(at[1:] == at[:-1] + 1)
        first = first[follows[at[first] + k - 2]]
        counted = counted[first] & counted[first + 1]
        at = at[first]
        last = code[at + k - 1]
        whole = _longer(whole[first], hashes[last])
        start, hashed = at[~counted], whole[~counted]
        if len(start):
            ident = code[start]
            for j in range(1, k):
                _, met, ident, n = np.unique(ident << 32 | code[start + j], return_index=True, return_inverse=True,
                                             return_counts=True)
            parts = [words.take(pa.array(code[start[met] + j])) for j in range(k)]
            yield k, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), n, hashed[met]


def _pack(lang: str, k: int, phrases: pa.Array, n: np.ndarray, hashes: np.ndarray, groups: int) -> dict[str, list]:
    """The counts of a block as one row a group."""
    group = ((hashes * _MIX) >> np.uint64(32)).astype(np.int64) % groups
    order = np.argsort(group, kind="stable")
    group, n = group[order], n[order].astype("<i8")
    ended = pc.binary_join_element_wise(phrases.take(pa.array(order)), pa.scalar(b"", pa.large_binary()),
                                        pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
    data = memoryview(ended.buffers()[2])
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return {"lang": [lang] * len(spans), "k": [k] * len(spans), "grp": group[cut[:-1]],
            "phrases": [bytes(data[offsets[i]:offsets[j]]) for i, j in spans], "counts": [n[i:j].tobytes() for i, j in spans]}


def _add_up(rows: pa.Table, least: int) -> pa.Table:
    """The phrases of one group with their summed counts, at ``least`` or more (all of length 0)."""
    raw = np.frombuffer(b"".join(rows["phrases"].to_pylist()), np.uint8)
    n = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<i8")
    ends = np.flatnonzero(raw == 10)
    offsets = np.concatenate([[0], ends + 1 - np.arange(1, len(ends) + 1)]).astype(np.int64)
    entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[raw != 10]))]).dictionary_encode()
    code = entries.indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(entries.dictionary), np.int64)
    np.add.at(total, code, n)
    lang, k = rows["lang"][0].as_py(), rows["k"][0].as_py()
    kept = np.flatnonzero(total >= (least if k else 0))
    return pa.table({"lang": pa.array([lang] * len(kept), pa.string()), "k": pa.array([k] * len(kept), pa.int32()),
                     "phrase": entries.dictionary.take(pa.array(kept)).cast(pa.binary()).cast(pa.string()),
                     "n": pa.array(total[kept], pa.int64())})


def _counted(docs: DataFrame, old: list[BitSet], new: list[BitSet], most: int, words_too: bool, least: int,
             block: int, groups: int) -> DataFrame:
    """Sums of one pass, at ``least`` or more; length 0 holds the number of words."""
    old, new = (docs.sparkSession.sparkContext.broadcast(x) for x in (old, new))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for lang, text in _blocks(batches, block):
            for k, phrases, n, hashes in _count_block(lang, text, old.value, new.value, most, words_too):
                yield _pack(lang, k, phrases, n, hashes, groups)

    return map_rows(docs, PACKED, run).groupBy("lang", "k", "grp").applyInArrow(lambda t: _add_up(t, least), COUNTS)


def _missing(counts: DataFrame, k: int, bits: BitSet) -> pa.Table:
    """Bits of the phrases of ``k`` words in ``counts`` that ``bits`` does not admit."""
    held = counts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            lang, phrase = b["lang"].to_pylist(), b["phrase"].to_pylist()
            for name in set(lang):
                own = [p.encode().split(b" ") for p, x in zip(phrase, lang, strict=True) if x == name]
                columns = [_word_hashes(name, [w[j] for w in own]) for j in range(k)]
                h = columns[0]
                for c in columns[1:]:
                    h = _longer(h, c)
                h = h[~held.value.holds(h)]
                slot, bit = held.value.place(h)
                yield {"k": np.full(len(h), k, np.int8), "slot": slot.astype(np.int32), "bits": bit.view(np.int64)}

    slots = map_rows(counts.where(F.col("k") == k).select("lang", "phrase"), BITS, run)
    return slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()


def _widened(bits: BitSet, more: pa.Table) -> BitSet:
    out = BitSet(bits.size)
    out.words[:] = bits.words
    slot = more["slot"].to_numpy()
    out.words[slot] |= more["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample: int = SAMPLE,
                     lowered: float = LOWERED, block: int = BLOCK, most_bits: int = MOST_BITS) -> DataFrame:
    """Every phrase of up to ``max_words`` words that occurs ``min_count`` times or more in
    its language, with its exact count: ``lang, k, phrase, n``. Rows of length 0 hold the
    number of all words of a language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
                       (F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).alias("drawn"))
    drawn, rows = rows.where("drawn").drop("drawn"), rows.drop("drawn")
    least = max(1, int(lowered * min_count / sample))
    # the sample, length by length
    proposed: list[BitSet] = []
    groups = 16
    for k in range(1, max_words):
        found = staged(_counted(drawn, proposed[:-1], proposed, k, k == 1, least, block, groups), f"phrases-sample{k}")
        if k == 1:
            words = found.where("k = 0").agg(F.sum("n")).first()[0] or 0
            groups = max(groups, -(-words * sample // GROUP))
        found = found.where(F.col("k") == k)
        size = min(most_bits, max(LEAST_BITS, (16 * found.count()).bit_length()))
        proposed.append(_widened(empty := BitSet(size), _missing(found, k, empty)))
    # passes over all documents until no border phrase fails
    old: list[BitSet] = []
    parts: list[DataFrame] = []
    while True:
        parts.append(staged(_counted(rows, old, proposed, max_words, not parts, min_count, block, groups),
                            f"phrases-pass{len(parts)}"))
        failed = [_missing(parts[-1], k, proposed[k - 1]) for k in range(1, max_words)]
        if not any(f.num_rows for f in failed):
            break
        old, proposed = proposed, [_widened(b, f) for b, f in zip(proposed, failed, strict=True)]
    return _united(spark, parts)


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact to 38 digits."""
    big = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, *, top: int = TOP, covered: int = 50, **mining) -> DataFrame:
    """Each language's ``top`` phrases of two words or more: ``lang, rank, phrase, a, l, r, n, score``.
    A phrase whose words lie inside a longer frequent one that has ``covered`` percent of its
    occurrences or more is left out."""
    counts = frequent_phrases(docs, **mining)
    total = counts.where("k = 0").select("lang", F.col("n").alias("n"))
    part = counts.where("k > 0").select("lang", "phrase", "n")
    cand = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    join = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = (cand.withColumn("words", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "k", "a", "cut", join(F.lit(1), F.col("cut")).alias("first"),
                    join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("low")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    inner = (cand.where("k > 2").withColumn("words", words)
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
             .groupBy("lang", join(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer")))
    left = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
            .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                             "n", "score")
