"""Near-duplicate classes by ProbMinHash.

A text is the weighted set of its 5-word shingles (weight 1 + ln of the count).
Every shingle runs a Poisson process at the rate of its weight; each arrival
falls into one of the signature's registers, which keeps the earliest. A
shingle's process stops once it passes the latest register, so later arrivals
are never drawn. Two texts agree on a register with the chance of their
probability Jaccard similarity. A text that repeats shingles has a second
signature with all weights 1, since pairs are verified by plain similarity.
Registers are banded; texts that share a band
are candidates, and candidates are verified by the exact Jaccard similarity of
their 5-word shingle sets.

Scale and skew: equal texts are one node, found by a 128-bit key. Every member of a
bucket is compared with the bucket's anchor, its text that shares buckets with most
others; texts with a common anchor form a group. Where a group still holds several
classes, rounds draw ``DRAWS`` of its classes and compare all members with a member
of each, as long as that links. Then every pair of a group that could still link two
classes is compared, so no candidate link is missed: in groups of up to ``FEW`` members
all pairs of different classes, in larger ones those whose differences from the anchor
overlap enough. Let da be the set difference of a and the anchor: a and b differ
in |da| + |db| - 2 |da & db| shingles and link if that is at most (|a| + |b|) / 9, so
they must share (s(a) + s(b)) / 2 elements of da and db, with s(x) = |dx| - |x| / 9.
(Where that is not above 0 both link to the anchor.) With the rarest elements of
a group first, two such sets meet within |a| / 9 - (s(b) - s(a)) / 2 + 1 and |b| / 9 +
(s(b) - s(a)) / 2 + 1 elements. Near copies whose edits are their own share no element that
early, so a large family just under the threshold makes few pairs. Only texts of
candidates are kept for verification, one per node, and a pair's texts meet by joins on
keys, never gathered by group.

Defined cases: equal texts share a class, null counts as empty. Texts without
words have no shingles and no other links; texts of 1 to 4 words have one
shingle, all their words. A class is named by its least document id (null if
no member has one); repeated rows are rows of the same class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from hearth.llm.common import staged, text_key, worker_store
from hearth.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
DRAWS, ROUNDS = 3, 6
PROGRESS = 0.02  # a round that links a smaller share of its pairs is the last
MOST_ELEMENTS = 1_000_000  # elements of differences that one task holds
FEW = 64  # members of a group whose pairs of different classes are all compared
FEW_PAIRS = 200_000  # of two 16-byte keys and two labels each: at most some 16 MB
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_KEPT_WORDS = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of all 5-word shingles of a whole text in order; words are runs of
        characters other than ASCII white space."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(h))
        if not width:
            return h
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = _mix(out * _GOLDEN + h[i:i + n])
        return out


def probminhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element of the earliest arrival in each register (``uint64``).

    Arrival j of an element depends only on the element, its weight and j.
    Arrivals are drawn in blocks for the elements still before the latest
    register; at least one element is needed."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    e, w = elements, weights
    time = np.zeros(len(e))
    drawn = 0
    while len(e):
        block = max(1, -(-2 * registers // len(e)))
        j = np.arange(drawn + 1, drawn + 1 + block, dtype=np.uint64)
        bits = _mix(e[:, None] + j * _GOLDEN)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / w[:, None]
        at = np.cumsum(gaps, axis=1) + time[:, None]
        register = (_mix(bits) % np.uint64(registers)).astype(np.int64).ravel()
        flat = at.ravel()
        near = np.flatnonzero(flat < first.max())
        order = near[np.argsort(-flat[near], kind="stable")]
        best = np.full(registers, np.inf)
        best[register[order]] = flat[order]  # the last assignment, the earliest arrival, stays
        who = np.zeros(registers, np.uint64)
        who[register[order]] = e[order // block]
        better = best < first
        first[better], winner[better] = best[better], who[better]
        time, drawn = at[:, -1], drawn + block
        alive = time < first.max()
        e, w, time = e[alive], w[alive], time[alive]
    return winner


def band_hashes(text: str | None, words: WordHashes) -> np.ndarray:
    """One 64-bit hash per band; none for a text without words. A text that repeats
    shingles has the bands of weight 1 as well, the only ones of a text that doesn't: with
    equal weights, registers agree with the chance of the plain Jaccard similarity."""
    found, counts = np.unique(words.shingles(text), return_counts=True)
    if not len(found):
        return np.zeros(0, np.int64)
    weights = [np.ones(len(found))] + ([1 + np.log(counts)] if counts.max() > 1 else [])
    out = []
    for w in weights:
        signature = probminhash(found, w, BANDS * ROWS).reshape(BANDS, ROWS)
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = _mix(h * _GOLDEN + signature[:, r])
        out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def bands_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    worker_store("near-duplicates")
    words = WordHashes()
    for batch in batches:
        yield pd.Series([band_hashes(t, words) for t in batch], dtype=object)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@F.pandas_udf(DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Exact shingle Jaccard of two texts; the second one's set is kept while it repeats."""
    worker_store("near-duplicates")
    words, last, kept = WordHashes(), None, np.zeros(0, np.uint64)
    for left, right in batches:
        out = []
        for a, b in zip(left, right, strict=True):
            if b != last or last is None:
                last, kept = b, np.unique(words.shingles(b))
            out.append(jaccard(np.unique(words.shingles(a)), kept))
        yield pd.Series(out, dtype="float64")


def _pairs(rows: DataFrame, *centres: str) -> DataFrame:
    """Distinct pairs ``(member, centre)`` of ``rows(key, ..)`` with the lesser key as centre."""
    each = F.explode(F.array(*centres))
    pairs = rows.select("key", each.alias("centre")).where(F.col("key") != F.col("centre"))
    return pairs.select(F.greatest("key", "centre").alias("member"), F.least("key", "centre").alias("centre")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, few: bool = False) -> DataFrame:
    """The rows of ``pairs`` whose texts reach the threshold, by joins on the keys; ``few``
    pairs are broadcast, so only their texts move."""
    own, centres = pairs, pairs.select("centre").distinct()
    if few:
        own, centres = F.broadcast(own), F.broadcast(centres)
    left = texts.withColumnsRenamed({"key": "member", "text": "_a"}).join(own, "member")
    right = texts.withColumnsRenamed({"key": "centre", "text": "_b"}).join(centres, "centre")
    return left.join(right, "centre").where(similarity("_a", "_b") >= SIMILARITY).select(*pairs.columns)


@F.pandas_udf(StructType([StructField("n", IntegerType()), StructField("delta", ArrayType(LongType()))]))
def difference(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Size of a text's shingle set, and the shingles that only one of it and its anchor has."""
    words, last, kept = WordHashes(), None, np.zeros(0, np.uint64)
    for left, right in batches:
        n, delta = [], []
        for a, b in zip(left, right, strict=True):
            if b != last or last is None:
                last, kept = b, np.unique(words.shingles(b))
            own = np.unique(words.shingles(a))
            n.append(len(own))
            delta.append(np.setxor1d(own, kept, assume_unique=True).view(np.int64))
        yield pd.DataFrame({"n": n, "delta": pd.Series(delta, dtype=object)})


def _all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different classes of ``rows(anchor, key, component)`` that share an anchor."""
    other = rows.select("anchor", F.col("key").alias("centre"), F.col("component").alias("_centre"))
    met = rows.join(other, "anchor").where((F.col("key") > F.col("centre")) & (F.col("component") != F.col("_centre")))
    return met.select(F.col("key").alias("member"), "centre")


def _pairs_within(rows: pa.Table) -> pa.Table:
    """:func:`_overlapping_pairs` of one group of at most ``MOST_ELEMENTS`` elements, in arrays."""
    keys, n = rows["key"].to_pylist(), rows["n"].to_numpy()
    _, component = np.unique(np.array([c.hex() for c in rows["component"].to_pylist()]), return_inverse=True)
    delta = rows["delta"].combine_chunks()
    flat, size = delta.flatten().to_numpy(), np.diff(delta.offsets.to_numpy())
    s = size - n / 9
    owner = np.repeat(np.arange(len(keys)), size)
    _, element, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((element, often[element], owner))  # of each text, the rarest first
    owner, element = owner[order], element[order]
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + 1
    probe = (often[element] > 1) & (at <= n[owner] / 4 + 2)
    owner, element, at = owner[probe], element[probe], at[probe]
    low = np.flatnonzero(at <= n[owner] / 9 + 2)
    low = low[np.argsort(element[low], kind="stable")]
    first, last = (np.searchsorted(element[low], element, side) for side in ("left", "right"))
    found = np.zeros(0, np.int64)
    width = np.concatenate([[0], np.cumsum(last - first)])
    start = 0
    while start < len(owner):  # as many entries at a time as meet some MOST_ELEMENTS others
        stop = max(start + 1, int(np.searchsorted(width, width[start] + MOST_ELEMENTS, "right")) - 1)
        each = np.repeat(np.arange(start, stop), (last - first)[start:stop])
        other = low[np.arange(len(each)) - np.repeat(width[start:stop] - width[start], (last - first)[start:stop]) + first[each]]
        b, a = owner[each], owner[other]
        half = (s[b] - s[a]) / 2
        met = ((component[a] != component[b]) & ((s[a] < s[b]) | ((s[a] == s[b]) & (a < b)))
               & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
               & (at[each] <= n[b] / 9 + half + 2) & (at[other] <= n[a] / 9 - half + 2))
        found = np.union1d(found, a[met].astype(np.int64) * len(keys) + b[met])
        start = stop
    pairs = [(keys[i], keys[j]) for i, j in zip(found // max(len(keys), 1), found % max(len(keys), 1), strict=True)]
    return pa.table({"member": pa.array([max(p) for p in pairs], pa.binary()), "centre": pa.array([min(p) for p in pairs], pa.binary())})


def _overlapping_pairs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of different classes of ``rows(anchor, key, component)`` whose differences from their
    anchor share an element as early as those of a link must. Groups of at most ``MOST_ELEMENTS``
    elements in all are worked on in a task each, larger ones by joins on (anchor, element)."""
    own = texts.withColumnRenamed("text", "_a").join(rows, "key")
    anchor = texts.withColumnsRenamed({"key": "anchor", "text": "_b"}).join(rows.select("anchor").distinct(), "anchor")
    apart = staged(own.join(anchor, "anchor").select("anchor", "key", "component", difference("_a", "_b").alias("d"))
                   .select("anchor", "key", "component", "d.*"), "differences")
    size = apart.groupBy("anchor").agg(F.sum(F.size("delta")).alias("elements"))
    small, large = (apart.join(size.where(keep).select("anchor"), "anchor", "left_semi")
                    for keep in (F.col("elements") <= MOST_ELEMENTS, F.col("elements") > MOST_ELEMENTS))
    pairs = small.groupBy("anchor").applyInArrow(_pairs_within, "member binary, centre binary")
    return pairs if large.isEmpty() else pairs.union(_pairs_by_joins(large))


def _pairs_by_joins(apart: DataFrame) -> DataFrame:
    """:func:`_overlapping_pairs` of groups of any size, of ``apart(anchor, key, component, n, delta)``."""
    each = apart.select("anchor", "key", F.explode("delta").alias("e"))
    often = each.groupBy("anchor", "e").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    # elements of one text alone come first and meet nothing; the others follow, rarest first
    member = Window.partitionBy("anchor", "key")
    shared = each.join(often, ["anchor", "e"]).select(
        "anchor", "key", "e", F.row_number().over(member.orderBy("f", "e")).alias("at"), F.count("*").over(member).alias("many"))
    size = apart.select("anchor", "key", "component", "n", F.size("delta").alias("apart"),
                        (F.size("delta") - F.col("n") / 9).alias("s"))
    # a link's partner has at most 1.25 n shingles: more than n / 4 + 1 elements are never looked at
    ranked = (shared.join(size, ["anchor", "key"]).withColumn("at", F.col("at") + F.col("apart") - F.col("many"))
              .where(F.col("at") <= F.col("n") / 4 + 2).drop("many", "apart"))
    ranked = staged(ranked, "ranked")
    lower = ranked.where(F.col("at") <= F.col("n") / 9 + 2).select(
        "anchor", "e", *[F.col(c).alias(f"_{c}") for c in ("key", "component", "n", "s", "at")])
    half = (F.col("s") - F.col("_s")) / 2
    met = ranked.join(lower, ["anchor", "e"]).where(
        (F.col("component") != F.col("_component"))
        & ((F.col("_s") < F.col("s")) | ((F.col("_s") == F.col("s")) & (F.col("_key") < F.col("key"))))
        & (5 * F.least("n", "_n") >= 4 * F.greatest("n", "_n"))
        & (F.col("at") <= F.col("n") / 9 + half + 2) & (F.col("_at") <= F.col("_n") / 9 - half + 2))
    return met.select(F.greatest("key", "_key").alias("member"), F.least("key", "_key").alias("centre"))


def _open_pairs(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(member, centre)`` of different classes of ``rows(anchor, key, component)`` that may
    still link and share an anchor."""
    size = rows.groupBy("anchor").agg(F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = staged(rows.join(size.where(F.col("lo") != F.col("hi")).drop("lo", "hi"), "anchor"), "open")
    small, large = rows.where(F.col("many") <= FEW).drop("many"), rows.where(F.col("many") > FEW).drop("many")
    pairs = _all_pairs(small)
    if not large.isEmpty():
        pairs = pairs.union(_overlapping_pairs(large, texts))
    return pairs.distinct()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and ``bands`` of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       bands_of(F.coalesce(F.col("text"), F.lit(""))).alias("bands"))


def classes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(key, doc_id, class_key)`` per distinct text: ``doc_id`` is the least id of the
    text's rows, ``class_key`` names its class. ``rows`` is the written result of
    :func:`signatures`."""
    nodes = staged(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = staged(banded.join(buckets, "band"), "shared")
    # the text that meets most others is nearest to all of its family
    weight = shared.groupBy("key").agg(F.sum("n").alias("met"))
    weighed = shared.select("band", "key").join(weight, "key")
    middle = weighed.groupBy("band").agg(F.max(F.struct("met", "key"))["key"].alias("middle"))
    # one text per candidate key; copies of a text are collapsed in each task
    texts = staged(docs.select(text_key(F.col("text")).alias("key"), "text").groupBy("key")
                   .agg(F.first("text").alias("text"))
                   .join(shared.select("key").distinct(), "key", "left_semi"), "texts")
    grouped = staged(shared.join(middle, "band").select(F.col("middle").alias("anchor"), "key").distinct(), "grouped")
    tested = staged(_pairs(grouped, "anchor"), "pairs")
    links = staged(_verified(tested, texts).select(F.col("member").alias("a"), F.col("centre").alias("b")), "links")
    found = components(links).withColumnsRenamed({"node": "key"})
    open_rows = grouped.join(found, "key", "left").select("anchor", "key", F.coalesce("component", "key").alias("component"))
    turn = 0
    while turn < ROUNDS:
        # a draw takes a class at random, then a member of it: a lone text faces all of a large class
        draws = [F.min(F.struct(F.xxhash64(F.lit(DRAWS * turn + i), "component").alias("c"),
                                F.xxhash64(F.lit(DRAWS * turn + i), "key").alias("h"), "key", "component")).alias(f"d{i}")
                 for i in range(DRAWS)]
        mixed = (open_rows.groupBy("anchor").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *draws)
                 .where(F.col("lo") != F.col("hi")).select("anchor", F.array(*[f"d{i}" for i in range(DRAWS)]).alias("draws")))
        # groups of one class are done; the others go on with fewer rows each round
        open_rows = staged(open_rows.join(mixed, "anchor"), "open")
        met = open_rows.select("key", "component", F.explode("draws").alias("d")).where(
            F.col("component") != F.col("d.component"))
        ahead = F.col("key") > F.col("d.key")  # a pair's lesser key is its centre
        fresh = met.select(*[F.when(ahead, x).otherwise(y).alias(name) for x, y, name in (
            (F.col("key"), F.col("d.key"), "member"), (F.col("component"), F.col("d.component"), "_member"),
            (F.col("d.key"), F.col("key"), "centre"), (F.col("d.component"), F.col("component"), "_centre"))]).distinct()
        fresh = staged(fresh.join(tested, ["member", "centre"], "left_anti"), "pairs")
        compared = fresh.count()
        few = compared <= FEW_PAIRS
        new = staged(_verified(fresh, texts, few), "links")
        tested = tested.union(fresh.select("member", "centre"))
        turn += 1
        linked = new.count()
        if linked:
            merged = components(new.select(F.col("_member").alias("a"), F.col("_centre").alias("b")))
            merged = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
            open_rows = open_rows.select("anchor", "key", "component").join(
                F.broadcast(merged) if few else merged, "component", "left").select(
                "anchor", "key", F.coalesce("now", "component").alias("component"))
            links = links.union(new.select(F.col("member").alias("a"), F.col("centre").alias("b")))
        if linked <= PROGRESS * compared:
            break
    open_rows = open_rows.select("anchor", "key", "component")
    last = staged(_open_pairs(open_rows, texts).join(tested, ["member", "centre"], "left_anti"), "pairs")
    new = staged(_verified(last, texts, last.count() <= FEW_PAIRS), "links")
    links = links.union(new.select(F.col("member").alias("a"), F.col("centre").alias("b")))
    found = components(links).withColumnsRenamed({"node": "key"})
    return nodes.select("key", "doc_id").join(found, "key", "left").select(
        "key", "doc_id", F.coalesce("component", "key").alias("class_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``class_id`` and
    ``class_rows``, the rows of the class."""
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs), "rows")
    per_text = rows.groupBy("key").agg(F.count("*").alias("n"))
    named = classes(rows, docs).join(per_text, "key")
    total = named.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_rows"))
    by_text = named.select("key", "class_key").join(total, "class_key").select("key", "class_id", "class_rows")
    return rows.select("doc_id", "key").join(by_text, "key").select("doc_id", "class_id", "class_rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class the row with
    the least document id (a row with an id before one without)."""
    narrow = docs.select("doc_id", "text")
    rows = staged(signatures(narrow), "rows")
    best = (classes(rows, narrow).groupBy("class_key")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
            .select("best.key", "best.doc_id"))
    counted = rows.groupBy("key", "doc_id").agg(F.count("*").alias("_n")).select(
        F.col("key").alias("_k"), F.col("doc_id").alias("_i"), "_n")
    kept = staged(best.join(counted, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_i")))
                  .select("_k", "_i", "_n"), "kept")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), text_key(F.col("text")).alias("_key"))
    chosen = whole.join(kept, (F.col("_key") == F.col("_k")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_i")))
    if kept.where(F.col("_n") > 1).isEmpty():
        return chosen.select("_row.*")
    # rows repeated with their id and text: one of each stays
    return (chosen.where(F.col("_n") == 1).select("_row")
            .union(chosen.where(F.col("_n") > 1).dropDuplicates(["_k", "_i"]).select("_row")).select("_row.*"))
