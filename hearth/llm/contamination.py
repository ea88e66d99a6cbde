"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for every word that a benchmark item uses, where it stands in
the training texts: postings ``(row, terms, positions)`` in text order, written once, and
from them lists ``(term, row, position)``. A phrase is looked up from its rarest
term: that term's list, moved by the term's place in the phrase, gives the places
where the phrase could start; the list of its next rarest term, moved alike, must
name the same places. What is left is compared term by term with the row's
postings, which is exact: every word of a phrase is a term of the index.

An item's windows share their rare terms, so what is looked up is a diagonal (row,
item, text position less item position), not each window; a diagonal's matching
words then show all windows on it at once.

Scale: terms go to the tasks as a dictionary of at most ``MOST_TERMS`` words; a
larger vocabulary is dealt by hash into several such dictionaries, with one pass
over the texts for each. Lists are joined by term, or by term and place. The
lookups (a few numbers for each window) are broadcast up to ``MOST_LOOKUPS`` rows
and beyond that joined by term and a salt, so that a frequent term's list is
never met by one task. Rows are numbered, so repeated or null ids stay apart.

Defined cases: null has no words; an item without words has no windows; an item
without an id makes words hit, and is in no list of items; items of one id count
once; an empty benchmark leaves every document clean; extra columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from hearth.llm.common import map_rows, staged

WINDOW = 10
MOST_TERMS, MOST_LOOKUPS, SALTS = 1_000_000, 500_000, 32

#: Lower case for A-Z, a space for every other ASCII character that is no digit or letter.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

ITEMS = StructType([StructField("seq", LongType()), StructField("item", StringType()),
                    StructField("words", ArrayType(StringType()))])
POSTINGS = StructType([StructField("n_words", LongType()), StructField("terms", ArrayType(IntegerType())),
                       StructField("positions", ArrayType(IntegerType()))])
RUNS = StructType([StructField("row", LongType()), StructField("seq", LongType()), StructField("item", StringType()),
                   StructField("start", LongType()), StructField("length", LongType()),
                   StructField("item_start", LongType())])
SPANS = StructType([StructField("row", LongType()), StructField("seq", LongType()),
                    StructField("start", LongType()), StructField("length", LongType())])


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each item that has words as ``(seq, item, words)``; ``seq`` numbers the rows."""
    rows = items.select(F.monotonically_increasing_id().alias("seq"), F.col(item_id).cast("string").alias("item"),
                        F.col(text).alias("text"))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for b in batches:
            yield {"seq": b["seq"], "item": b["item"],
                   "words": [[w.decode() for w in words_of(t.as_py())] for t in b["text"].cast(pa.binary())]}

    return staged(map_rows(rows, ITEMS, run).where(F.size("words") > 0), "contamination-items")


def vocabulary(items: DataFrame) -> DataFrame:
    """The items' distinct words as ``(term, word, part)``; ``part`` deals them into dictionaries."""
    words = staged(items.select(F.explode("words").alias("word")).distinct(), "contamination-words")
    parts = max(1, -(-words.count() // (MOST_TERMS * 9 // 10)))
    numbered = words.select((F.monotonically_increasing_id()).alias("at"), "word",
                            F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part"))
    # numbers of partitions lie 2^33 apart: close the gaps with the partitions' sizes
    sizes = {r.p: r.n for r in numbered.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, start = [F.lit(0), F.lit(0)], 0
    for p in sorted(sizes):
        before += [F.lit(p).cast("long"), F.lit(start)]
        start += sizes[p]
    return staged(numbered.select((F.create_map(*before[2:] or [F.lit(0).cast("long"), F.lit(0)])[F.shiftright("at", 33)]
                                   + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("term"), "word", "part"),
                  "contamination-terms")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``row, doc_id, text``): its number of words, and the
    terms it holds with their positions, in text order."""
    schema = StructType([docs.schema["row"], docs.schema["doc_id"], *POSTINGS])
    parts = (terms.agg(F.max("part")).first()[0] or 0) + 1
    out = None
    for part in range(parts):
        table = terms.where(F.col("part") == part).select("word", "term").toArrow()
        known = docs.sparkSession.sparkContext.broadcast(
            dict(zip((w.encode() for w in table["word"].to_pylist()), table["term"].to_pylist(), strict=True)))

        def run(batches: Iterator[dict[str, pa.Array]], known=known) -> Iterator[dict]:
            get = known.value.get
            for b in batches:
                counts, terms, places = [], [], []
                for text in b["text"].cast(pa.binary()):
                    words = words_of(text.as_py())
                    found = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    at = np.flatnonzero(found >= 0)
                    counts.append(len(words))
                    terms.append(found[at])
                    places.append(at.astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int32))
                lists = {n: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0, np.int32)])))
                         for n, x in (("terms", terms), ("positions", places))}
                yield {"row": b["row"], "doc_id": b["doc_id"], "n_words": counts, **lists}

        found = staged(map_rows(docs.select("row", "doc_id", "text"), schema, run), f"contamination-postings{part}")
        out = found if out is None else out.unionAll(found)
    if parts > 1:
        pairs = F.flatten(F.collect_list(F.arrays_zip("positions", "terms")))
        out = staged(out.groupBy("row", "doc_id", "n_words").agg(F.array_sort(pairs).alias("p")).select(
            "row", "doc_id", "n_words", F.col("p.terms").alias("terms"), F.col("p.positions").alias("positions")),
            "contamination-postings")
    return out


def lists_of(index: DataFrame) -> DataFrame:
    """The inverted lists ``(term, row, position)`` of ``index``."""
    return (index.select("row", F.explode(F.arrays_zip("terms", "positions")).alias("p"))
            .select(F.col("p.terms").alias("term"), "row", F.col("p.positions").alias("position")))


def _lookups(items: DataFrame, terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of every window that can occur, with their places in the item:
    ``seq, t1, p1, t2, p2``. Windows that share both are one lookup."""
    often = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    placed = items.select("seq", F.posexplode("words").alias("p", "word"))
    placed = placed.join(terms.select("word", "term"), "word").join(often, "term", "left")
    entry = F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "term")
    whole = placed.groupBy("seq").agg(F.array_sort(F.collect_list(entry)).alias("w"))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    by_count = F.array_sort(F.transform(F.slice("w", F.col("at"), window), lambda e: F.struct(e["n"], e["p"], e["term"])))
    ends = by_count.getItem(0), F.get(by_count, F.least(F.lit(1), F.size(by_count) - 1))
    rarest = (whole.withColumn("at", start).select("seq", *(e.alias(f"e{i}") for i, e in enumerate(ends)))
              .where("e0.n > 0"))
    return staged(rarest.select("seq", F.col("e0.term").alias("t1"), F.col("e0.p").alias("p1"),
                                F.col("e1.term").alias("t2"), F.col("e1.p").alias("p2")).distinct(), "contamination-lookups")


def _met(lists: DataFrame, lookups: DataFrame, n: int) -> DataFrame:
    """The entries of ``lists`` with the lookups whose rarest term they are."""
    found = lookups.withColumnRenamed("t1", "term")
    if n <= MOST_LOOKUPS:
        return lists.join(F.broadcast(found), "term")
    salt = F.pmod(F.xxhash64("row", "position"), F.lit(SALTS)).cast("int")
    return lists.withColumn("salt", salt).join(
        found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"]).drop("salt")


def _needed(index: DataFrame, lookups: DataFrame, n: int) -> DataFrame:
    """The inverted lists of all looked-up terms, written."""
    asked = lookups.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    asked = F.broadcast(asked) if n <= MOST_LOOKUPS else asked
    return staged(lists_of(index).join(asked, "term", "left_semi"), "contamination-lists")


def _diagonals(index: DataFrame, lookups: DataFrame) -> DataFrame:
    """``(row, seq, diagonal)`` on which the two rarest terms of a window stand at their places."""
    n = lookups.count()
    lists = _needed(index, lookups, n)
    start = (F.col("position") - F.col("p1")).alias("diagonal")
    first = _met(lists, lookups, n).select("row", "seq", start, F.col("t2").alias("term"), "p2").where("diagonal >= -p2")
    first = first.withColumn("position", F.col("diagonal") + F.col("p2")).drop("p2").distinct()
    return first.join(lists, ["term", "row", "position"], "left_semi").select("row", "seq", "diagonal").distinct()


def _with_postings(index: DataFrame, found: DataFrame, items: DataFrame, terms: DataFrame, place: str) -> DataFrame:
    """Each row of the index that was found, with the items found in it and their places."""
    coded = (items.select("seq", "item", F.posexplode("words").alias("p", "word")).join(terms.select("word", "term"), "word")
             .groupBy("seq", "item").agg(F.array_sort(F.collect_list(F.struct("p", "term"))).alias("w"))
             .select("seq", "item", F.col("w.term").alias("phrase")))
    each = found.groupBy("row", "seq").agg(F.sort_array(F.collect_list(place)).alias("places"))
    few = (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= MOST_LOOKUPS
    each = each.join(F.broadcast(coded) if few else coded, "seq").groupBy("row").agg(F.collect_list(F.struct("seq", "item", "phrase", "places")).alias("found"))
    return index.join(each, "row")


def exact_runs(index: DataFrame, items: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every longest run of item words that stands in a row and holds a whole window:
    ``row, seq, item, start, length, item_start`` (places count from 0)."""
    found = _diagonals(index, _lookups(items, terms, index, window))

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in RUNS.names}
            for row, terms, places, found in zip(*(b[n] for n in ("row", "terms", "positions", "found")), strict=True):
                at, what = places.values.to_numpy(), terms.values.to_numpy()
                for f in found.as_py():
                    phrase = np.array(f["phrase"], np.int32)
                    need = min(window, len(phrase))
                    for diagonal in f["places"]:
                        here = np.searchsorted(at, diagonal + np.arange(len(phrase)))
                        here[here == len(at)] = 0
                        same = (at[here] == diagonal + np.arange(len(phrase))) & (what[here] == phrase)
                        edge = np.diff(same.astype(np.int8), prepend=0, append=0)
                        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                            if e - s >= need:
                                for name, v in zip(RUNS.names, (row.as_py(), f["seq"], f["item"], diagonal + s, e - s, s),
                                                   strict=True):
                                    out[name].append(v)
            yield out

    rows = _with_postings(index, found, items, terms, "diagonal").select("row", "terms", "positions", "found")
    return map_rows(rows, RUNS, run)


def near_runs(index: DataFrame, items: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """Proximity matches: each place where all words of an item (each as often as the item has
    it) stand, in any order, within ``span`` consecutive words of a row, and no shorter part of it
    holds them: ``row, seq, start, length``."""
    size = items.agg(F.max(F.size("words"))).first()[0] or 1
    lookups = _lookups(items, terms, index, size)  # the whole item is one window
    n = lookups.count()
    found = _met(_needed(index, lookups, n), lookups, n).select("row", "seq", "position").distinct()

    def run(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in SPANS.names}
            for row, terms, places, found in zip(*(b[n] for n in ("row", "terms", "positions", "found")), strict=True):
                at, what = places.values.to_numpy(), terms.values.to_numpy()
                for f in found.as_py():
                    for s, e in _covers(at, what, f["phrase"], f["places"], span):
                        for name, v in zip(SPANS.names, (row.as_py(), f["seq"], s, e - s + 1), strict=True):
                            out[name].append(v)
            yield out

    rows = _with_postings(index, found, items, terms, "position").select("row", "terms", "positions", "found")
    return map_rows(rows, SPANS, run)


def _covers(at: np.ndarray, what: np.ndarray, phrase: list[int], anchors: list[int], span: int) -> list[tuple[int, int]]:
    """Shortest stretches of at most ``span`` positions that hold the whole phrase, around the anchors."""
    need: dict[int, int] = {}
    for t in phrase:
        need[t] = need.get(t, 0) + 1
    anchors = np.array(anchors)
    wanted = np.flatnonzero(np.isin(what, list(need)))
    close = np.searchsorted(anchors, at[wanted] - span, side="right") < np.searchsorted(anchors, at[wanted] + span)
    wanted = wanted[close]
    held, missing, left, out = dict.fromkeys(need, 0), len(phrase), 0, []
    for right in wanted:
        held[what[right]] += 1
        missing -= held[what[right]] <= need[what[right]]
        shrunk = False
        while missing == 0:
            start, t = wanted[left], what[wanted[left]]
            held[t] -= 1
            left += 1
            if held[t] < need[t]:
                missing += 1
                shrunk = True
        if shrunk and at[right] - at[start] < span:
            out.append((int(at[start]), int(at[right])))
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row, doc_id, text`` with a number for each row."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document: ``doc_id, n_words, n_hit`` (words inside an occurrence of a window of
    ``window`` item words), ``items`` (ids of items with such windows, sorted as strings) and
    ``contaminated``."""
    rows, items = numbered(docs), item_words(benchmark)
    terms = vocabulary(items)
    if (terms.agg(F.max("part")).first()[0] or 0) > 0:  # several passes: number the rows once
        rows = staged(rows, "contamination-rows")
    index = postings(rows, terms)
    runs = exact_runs(index, items, terms, window)
    # words inside runs that overlap count once: lengths of merged runs
    one = runs.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("runs"),
        F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))
    hit = F.aggregate("runs", empty, lambda acc, r: F.struct(
        (acc["n"] + F.greatest(r["stop"] - F.greatest(r["start"], acc["stop"]), F.lit(0))).alias("n"),
        F.greatest(acc["stop"], r["stop"]).alias("stop")), lambda acc: acc["n"])
    one = one.select("row", hit.alias("n_hit"), "items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return index.select("row", "doc_id", "n_words").join(one, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), (n_hit > 0).alias("contaminated"))
