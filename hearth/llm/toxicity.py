"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram language models, one of toxic and one of ordinary text,
are interpolated Kneser-Ney models of order :data:`ORDER`. Their top-order
counts are per class; everything below the top order is one distribution of
continuation counts shared by both, so a rare or unseen expression backs off
to the same place in both models and says little. The two log-likelihoods are
compared per symbol, passage by passage: a text's evidence is the largest
length-normalised difference over all passages of :data:`PASSAGE` symbols, so a
single expression counts alike in a short and a very long text.

Beside it stands a model of whole words over their real characters, of any
script and length: each symbol of a word, its end included, is predicted from
the whole word so far, again by two class models with one shared backoff (the
continuation counts of three symbols). A word's evidence is the sum along its
symbols, up to the first beginning that one of the classes has never met. The
text's most telling word and the sum of its clear words (:data:`CLEAR`) over
the root of its number of words add up what several expressions say. A logistic
calibration of the three turns the evidence into a score from 0 to 1.

The beginnings of words are 64-bit keys, counted and joined as Spark tables that
grow with the vocabulary. Tasks receive those that both classes have met as
contexts, so what the driver and a worker hold grows with the vocabulary of the
toxic training texts.

For the passages texts are reduced to :data:`SYMBOLS` symbol classes, so an n-gram table has at
most ``SYMBOLS ** ORDER`` entries whatever the corpus: counting gathers n-grams
of every labelled training text (partially summed in each task), yet the model
that tasks receive has that proven bound.

Calibration is fitted on scores of texts that the scoring model has not seen:
the training rows are halved by a text hash, each half is scored by a model of
the other, and a bounded sample of them (``CALIBRATION_ROWS``) is collected.

Defined cases: a null or empty text carries no evidence and gets the score of
zero evidence. Rows with a null label are not learned from; several labels of
one document count as several rows. Without any toxic (or ordinary) training
text every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from hearth.llm.common import map_rows, staged, texts, worker_store
from hearth.llm.neardup import _GOLDEN, _mix

ORDER = 5
SYMBOLS = 28  # 0 space and other marks, 1-26 letters, 27 anything else that is a letter or digit
DISCOUNT = 0.9
PASSAGE = 10
CALIBRATION_ROWS = 20_000
FLUSH = 1 << 22
CLEAR = 2.0  # log-likelihood difference beyond which a word counts
PORTION = 1 << 21  # characters of the texts whose words are looked up together
UNSPACED = 8  # symbols of a word in scripts that set no spaces; one starts at every symbol
_KEPT_WORDS = 300_000

_COUNTS = StructType([StructField("gram", LongType(), False), StructField("half", IntegerType(), False),
                      StructField("toxic", LongType(), False), StructField("ordinary", LongType(), False)])

_CLASSES = ("t0", "o0", "t1", "o1")  # toxic and ordinary counts of each half
_WORDS = StructType([StructField("word", BinaryType(), False), *(StructField(c, LongType(), False) for c in _CLASSES)])
_NODES = StructType([*(StructField(c, LongType(), False) for c in ("node", "context", "tail")), *_WORDS.fields[1:]])
_WORD = re.compile(r"[^\s\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xbf\u2000-\u206f\u3000-\u303f]+")
_NO_SPACES = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
                        r"\U00020000-\U0003ffff]")


def _symbol(c: int) -> int:
    """Class of a code point: accents are dropped, letters beyond a-z share a class."""
    base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 if base.isalnum() else 0


def symbol_table() -> np.ndarray:
    """Classes of the Basic Multilingual Plane's first part; the last entry, class 27, is for what lies beyond it."""
    return np.array([*map(_symbol, range(0x2000)), 27], np.uint8)


def grams_of(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all ``ORDER``-grams of a text, one per symbol: base-``SYMBOLS`` numbers
    of the last ``ORDER`` symbols. Runs of class 0 become one; the text is padded with it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[np.minimum(points, len(table) - 1)]  # beyond the table: as its last entry
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.concatenate([np.zeros(ORDER - 1, np.int32), s, np.zeros(1, np.int32)], dtype=np.int32)
    n = len(s) - ORDER + 1
    codes = s[:n].copy()
    for i in range(1, ORDER):  # SYMBOLS ** ORDER is below 2^31
        codes *= SYMBOLS
        codes += s[i:i + n]
    return codes


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts of every n-gram of ``labelled(text, toxic, half)`` by half and class.
    Each task sums what it has read before anything is shuffled."""
    table = symbol_table()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def flush() -> dict:
            gram, half, toxic, ordinary = [], [], [], []
            for (h, label), codes in parts.items():
                g, n = np.unique(np.concatenate(codes), return_counts=True)
                gram.append(g)
                half.append(np.full(len(g), h, np.int32))
                toxic.append(n if label else np.zeros_like(n))
                ordinary.append(np.zeros_like(n) if label else n)
            parts.clear()
            return {k: np.concatenate(v) for k, v in
                    (("gram", gram), ("half", half), ("toxic", toxic), ("ordinary", ordinary))}

        for b in batches:
            for t, label, h in zip(texts(b["text"]), b["toxic"].to_pylist(), b["half"].to_pylist(), strict=True):
                codes = grams_of(t, table)
                parts.setdefault((h, label), []).append(codes)
                size += len(codes)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    return (map_rows(labelled.select("text", "toxic", "half"), _COUNTS, run)
            .groupBy("gram", "half").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))


def words_of(text: str) -> list[str]:
    """The words of a text in order, composed and in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    found = _WORD.findall(unicodedata.normalize("NFKC", text).lower())
    out = []
    for w in found:
        if _NO_SPACES.search(w):
            out.extend(w[i:i + UNSPACED] for i in range(len(w)))
        else:
            out.append(w)
    return out


def walk(words: list[str], go: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
    """All beginnings of the words, symbol by symbol: which words, the keys of their
    beginning and of the one before it, and the last three symbols. ``go`` tells which
    words go on from the beginning they have reached."""
    flat = np.frombuffer("".join(w + "\n" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    at, depth = np.arange(len(words)), 0
    context, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    while len(at):
        if go is not None:
            on = go(at, context)
            at, context, tail = at[on], context[on], tail[on]
        symbol = flat[start[at] + depth]
        node = _mix(context * _GOLDEN + symbol + np.uint64(1))
        tail = ((tail << np.uint64(21)) | symbol) & np.uint64((1 << 63) - 1)
        yield at, node, context, tail
        depth += 1
        on = size[at] > depth
        at, context, tail = at[on], node[on], tail[on]


def count_words(labelled: DataFrame) -> DataFrame:
    """``(node, context, tail, *_CLASSES)``: how often every beginning of a word occurs in
    ``labelled(text, toxic, half)``. Words are summed in each task, then by word."""
    def words(batches: Iterator[dict]) -> Iterator[dict]:
        parts = [Counter() for _ in _CLASSES]

        def flush() -> dict:
            known = list(set().union(*parts))
            out = {"word": [w.encode("utf-8", "surrogatepass") for w in known]}
            out |= {c: [p[w] for w in known] for c, p in zip(_CLASSES, parts, strict=True)}
            for p in parts:
                p.clear()
            return out

        for b in batches:
            for t, label, h in zip(texts(b["text"]), b["toxic"].to_pylist(), b["half"].to_pylist(), strict=True):
                parts[2 * h + (not label)].update(words_of(t))
                if sum(map(len, parts)) >= _KEPT_WORDS:
                    yield flush()
        if any(parts):
            yield flush()

    def nodes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            counts = [b[c].to_numpy(zero_copy_only=False) for c in _CLASSES]
            for at, node, context, tail in walk([w.decode("utf-8", "surrogatepass") for w in b["word"].to_pylist()]):
                yield {"node": node.view(np.int64), "context": context.view(np.int64), "tail": tail.view(np.int64),
                       **{c: n[at] for c, n in zip(_CLASSES, counts, strict=True)}}

    sums = [F.sum(c).alias(c) for c in _CLASSES]
    by_word = map_rows(labelled.select("text", "toxic", "half"), _WORDS, words).groupBy("word").agg(*sums)
    return map_rows(by_word, _NODES, nodes).groupBy("node").agg(
        F.first("context").alias("context"), F.first("tail").alias("tail"), *sums)


#: Toxic and ordinary counts that the models of the halves and of all rows are made of.
_MODELS = (("t0", "o0"), ("t1", "o1"), ("t0 + t1", "o0 + o1"))


def word_evidence(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of :func:`count_words`: ``(node, e0, e1, e2)``, the log-likelihood difference of a
    beginning's last symbol in the models of half 0, half 1 and all rows, and
    ``(context, r0, r1, r2)``, that of a symbol neither class has there. Null where one
    of the classes has not met the context."""
    pairs = [(F.expr(t), F.expr(o)) for t, o in _MODELS]
    sums = [x for m, pair in enumerate(pairs) for c, n in zip("to", pair, strict=True)
            for x in (F.sum(n).alias(f"{c}{m}_all"), F.count_if(n > 0).alias(f"{c}{m}_kinds"))]
    contexts = staged(nodes.groupBy("context").agg(*sums).where("t2_all > 0 and o2_all > 0"), "contexts")
    before = F.shiftright("tail", 21)
    tails = nodes.groupBy("tail").agg(F.count("*").alias("n")).withColumn("before", before)
    kinds = tails.groupBy("before").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_kinds"))
    shared = tails.join(kinds, "before").select("tail", (
        (F.col("n") - DISCOUNT + DISCOUNT * F.col("n_kinds") / (1 << 16)) / F.col("n_all")).alias("shared"))
    rows = nodes.join(contexts, "context").join(shared, "tail")

    def known(m: int, value: Column) -> Column:
        return F.when((F.col(f"t{m}_all") > 0) & (F.col(f"o{m}_all") > 0), value)

    def chance(m: int, c: str, n: Column) -> Column:
        return F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}{m}_kinds") * F.col("shared")

    def over(m: int) -> Column:
        return F.log(F.col(f"o{m}_all") / F.col(f"t{m}_all"))

    seen = rows.select("node", *[known(m, F.log(chance(m, "t", t) / chance(m, "o", o)) + over(m)).alias(f"e{m}")
                                 for m, (t, o) in enumerate(pairs)])
    rest = contexts.select("context", *[known(m, F.log(F.col(f"t{m}_kinds") / F.col(f"o{m}_kinds")) + over(m)).alias(f"r{m}")
                                        for m in range(len(pairs))])
    return seen, rest


def shared_backoff(grams: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each top-order n-gram's last symbol after the
    shortened context, from continuation counts pooled over both classes:
    for every lower order, how many different symbols stand before a string."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)  # order 0: uniform
    level = np.unique(grams)
    kinds = [level]
    for k in range(ORDER - 1, 0, -1):  # the different k-grams that end the (k+1)-grams seen
        level, before = np.unique(level % SYMBOLS ** k, return_counts=True)
        kinds.append((level, before))
    for k in range(1, ORDER):  # from unigrams up
        codes, n = kinds[ORDER - k]
        size = SYMBOLS ** k
        context = codes // SYMBOLS
        total = np.bincount(context, n, size // SYMBOLS)
        types = np.bincount(context, minlength=size // SYMBOLS)
        weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        # every context of this order, seen or not: the lower order's distribution, discounted, plus own counts
        lower = np.tile(p, SYMBOLS) if k > 1 else p
        full = np.repeat(weight, SYMBOLS) * lower
        full[codes] += (n - DISCOUNT) / total[context]
        p = full
    return p[grams % SYMBOLS ** (ORDER - 1)]


def evidence(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log P(symbol | context, toxic) - log P(symbol | context, ordinary) for the seen
    ``grams`` (sorted), and for each context the value of an n-gram that neither class has."""
    shared = shared_backoff(grams)
    contexts = SYMBOLS ** (ORDER - 1)
    context = grams // SYMBOLS
    logs, rest = [], []
    for counts in (toxic, ordinary):
        total = np.bincount(context, counts, contexts)
        types = np.bincount(context, counts > 0, contexts)
        weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        p = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[context], 1) + weight[context] * shared
        logs.append(np.log(p))
        rest.append(np.log(weight))
    return logs[0] - logs[1], rest[0] - rest[1]


@dataclass(frozen=True)
class Evidence:
    """The evidence of all n-grams as tasks receive it: values of seen n-grams, and of
    contexts for unseen ones. A worker spreads it once to one value per n-gram."""

    name: str
    parts: object  # a broadcast variable of (grams, seen, rest)

    @classmethod
    def of(cls, spark: SparkSession, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Evidence:
        order = np.argsort(grams)
        seen, rest = evidence(grams[order], toxic[order], ordinary[order])
        parts = (grams[order].astype(np.int32), seen.astype(np.float32), rest.astype(np.float32))
        return cls(uuid.uuid4().hex, spark.sparkContext.broadcast(parts))

    def table(self) -> np.ndarray:
        """``SYMBOLS ** ORDER`` numbers, kept by the worker (those of three models at most)."""
        kept = worker_store("toxicity").setdefault("tables", {})
        if self.name not in kept:
            grams, seen, rest = self.parts.value
            full = np.repeat(rest, SYMBOLS)
            full[grams] = seen
            while len(kept) > 2:
                kept.pop(next(iter(kept)))
            kept[self.name] = full
        return kept[self.name]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Words:
    """The evidence of words as tasks receive it."""

    name: str
    parts: object  # a broadcast variable of sorted (nodes, seen, contexts, rest)

    @classmethod
    def of(cls, spark: SparkSession, seen: pd.DataFrame, rest: pd.DataFrame) -> Words:
        parts = []
        for frame in (seen, rest):
            keys = frame.iloc[:, 0].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            parts += [keys[order], frame.iloc[:, 1].to_numpy(np.float32)[order]]
        return cls(uuid.uuid4().hex, spark.sparkContext.broadcast(tuple(parts)))

    def values(self, words: set[str]) -> dict[str, float]:
        """The evidence of at least these words; a bounded number is kept by the worker."""
        stores = worker_store("toxicity").setdefault("words", {})
        while len(stores) > 2 and self.name not in stores:
            stores.pop(next(iter(stores)))
        kept = stores.setdefault(self.name, {})
        if len(kept) > _KEPT_WORDS:
            kept.clear()
            fresh = list(words)
        else:
            fresh = [w for w in words if w not in kept]
        nodes, seen, contexts, rest = self.parts.value
        total, other = np.zeros(len(fresh)), np.zeros(len(fresh))

        def known(at: np.ndarray, context: np.ndarray) -> np.ndarray:
            i, there = _find(contexts, context)
            other[at[there]] = rest[i[there]]
            return there

        for at, node, _, _ in walk(fresh, known):
            i, there = _find(nodes, node)
            total[at] += np.where(there, seen[i] if len(seen) else 0.0, other[at])
        kept.update(zip(fresh, total.tolist(), strict=True))
        return kept

    def features_of(self, texts: Sequence[str | None]) -> list[tuple[float, float]]:
        """For each text, the evidence of its most telling word (0 at least), and of all clear words over
        the root of the number of words. The words of all texts are looked up together."""
        found = [words_of(t or "") for t in texts]
        values = self.values(set().union(*found))
        out = []
        for words in found:
            top = max(map(values.__getitem__, words), default=0.0)
            total = sum(v - CLEAR for v in map(values.__getitem__, words) if v > CLEAR) if top > CLEAR else 0.0
            out.append((max(top, 0.0), total / math.sqrt(max(len(words), 1))))
        return out


def _portions(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts in order, in portions of about ``PORTION`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass(frozen=True)
class ToxicityModel:
    """``evidence`` gives the log-likelihood difference of an n-gram's last symbol, ``words``
    that of words; ``slopes`` and ``intercept`` calibrate the three features."""

    evidence: Evidence
    words: Words
    intercept: float
    slopes: tuple[float, float, float]

    def score_of(self, text: Column) -> Column:
        """Score column: 0 to 1, higher for likelier toxic."""
        symbols, evidence, words, a, b = symbol_table(), self.evidence, self.words, self.intercept, self.slopes

        @F.pandas_udf(DoubleType())
        def score(column: pd.Series) -> pd.Series:
            values = evidence.table()
            out = []
            for part in _portions(column):
                for t, told in zip(part, words.features_of(part), strict=True):
                    x = (worst_passage(t, symbols, values), *told)
                    z = a + sum(k * v for k, v in zip(b, x, strict=True))
                    out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            return pd.Series(out, dtype="float64")

        return score(text)


def worst_passage(text: str | None, symbols: np.ndarray, table: np.ndarray) -> float:
    """The largest mean log-likelihood difference of ``PASSAGE`` symbols in a row;
    a shorter text counts as one passage."""
    codes = grams_of(text or "", symbols)
    sums = np.concatenate([np.zeros(1), np.cumsum(table[codes], dtype=np.float64)])
    if len(codes) <= PASSAGE:
        return float(sums[-1]) / PASSAGE
    return float((sums[PASSAGE:] - sums[:-PASSAGE]).max()) / PASSAGE


def _scored(rows: DataFrame, tables: list[Evidence], words: list[Words]) -> DataFrame:
    """The features of ``rows(text, toxic, half)`` by the models of the other half."""
    symbols = symbol_table()

    @F.pandas_udf(ArrayType(DoubleType()))
    def raw(text: pd.Series, half: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(text), dtype=object)
        for h in (0, 1):
            at, table = np.flatnonzero(half == h), tables[1 - h].table()
            told = [x for part in _portions(text.iloc[at]) for x in words[1 - h].features_of(part)]
            for i, x in zip(at, told, strict=True):
                out.iloc[i] = [worst_passage(text.iloc[i], symbols, table), *x]
        return out

    return rows.select(raw("text", "half").alias("x"), "toxic")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Intercept and slopes by Newton's method with a light ridge on the scaled inputs."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z, w = np.concatenate([np.ones((len(x), 1)), x / scale], 1), np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), 1e-2)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), tuple((w[1:] / scale).tolist())


def fit(spark: SparkSession, labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> ToxicityModel:
    """Learn from ``labelled(text, toxic)`` (toxic 0 or 1); with a ``doc_id``, calibration rows are drawn by it."""
    drawn_by = "doc_id" if "doc_id" in labelled.columns else "text"
    rows = staged(labelled.where(F.col("toxic").isNotNull())
                  .select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"),
                          F.xxhash64(drawn_by, F.lit(7)).alias("draw"))
                  .withColumn("half", half_of(F.col("text"))), "labelled")
    counts = count_grams(rows).toArrow().to_pandas()  # at most 2 * SYMBOLS ** ORDER rows
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, positive = sum(n.values()), n.get(1, 0)
    if not positive or positive == total or not counts["toxic"].sum() or not counts["ordinary"].sum():
        share = positive / total if total else 0.0
        none, no_words = np.zeros(0, np.int64), pd.DataFrame({"key": [], "e": []})
        return ToxicityModel(Evidence.of(spark, none, none, none), Words.of(spark, no_words, no_words),
                             math.log(max(share, 1e-9) / max(1 - share, 1e-9)), (0.0, 0.0, 0.0))
    seen, rest = (t.toArrow().to_pandas() for t in word_evidence(staged(count_words(rows), "word-nodes")))
    words = [Words.of(spark, seen[["node", f"e{m}"]].dropna(), rest[["context", f"r{m}"]].dropna())
             for m in range(len(_MODELS))]
    halves = []
    for h in (0, 1):
        part = counts[counts["half"] == h]
        halves.append(Evidence.of(spark, *(part[c].to_numpy(np.int64) for c in ("gram", "toxic", "ordinary"))))
    sample = rows
    if total > calibration_rows:  # the hash of the document's id decides, so copies of a text are drawn singly,
        share = int(calibration_rows / total * (1 << 30))  # and of rows that repeat an id one is drawn
        sample = rows.where(F.pmod("draw", F.lit(1 << 30)) < share).dropDuplicates(["draw"])
    held = _scored(sample, halves, words[:2]).toArrow().to_pandas()
    y = held["toxic"].to_numpy(float)
    intercept, slopes = (_logistic(np.stack(held["x"].to_list()), y) if 0 < y.sum() < len(y)
                         else (0.0, (1.0, 0.0, 0.0)))
    both = counts.groupby("gram", as_index=False)[["toxic", "ordinary"]].sum()
    for h in (*halves, *words[:2]):
        h.parts.unpersist()
    whole = Evidence.of(spark, *(both[c].to_numpy(np.int64) for c in ("gram", "toxic", "ordinary")))
    return ToxicityModel(whole, words[2], intercept, slopes)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column) -> DataFrame:
    """``(doc_id, text, toxic)`` of the documents for which ``use`` holds and that have a label.
    Labels grow with the documents, so both are sorted and merged by document id at any size."""
    marks = labels.select(F.col("doc_id").alias("_id"), "toxic").where(F.col("toxic").isNotNull())
    return (docs.select("doc_id", "text").where(use)
            .join(marks.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every row of ``docs(doc_id, text)``: ``doc_id``, ``score``, ``predicted``."""
    scored = docs.select("doc_id", model.score_of(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), model.score_of(F.col("text")).alias("_score"))
    return rows.where(F.col("_score") < 0.5).select("_row.*")
