"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its byte 2- and 3-grams (hashed to
``BUCKETS`` places, length 1). Every language has up to ``CENTROIDS`` centroids,
found by spherical k-means on a sample of its training texts; a text gets the
language of the centroid with the largest cosine. A text farther from it than
nearly all training texts of that centroid were is marked as rejected.

Scale: document frequencies are counted over all training texts, summed in each
task first (at most ``BUCKETS`` numbers a task). Only the clustering works on a
sample, of about ``SAMPLE_ROWS`` texts a language, chosen by a hash of the text;
a language's sample of bounded vectors is one group. The model has
``BUCKETS * CENTROIDS`` numbers a language. Prediction is one pass without a
shuffle.

Defined cases: a null text, and one without a letter, is ``und`` with score 0
(and rejected). Without training texts every text is. Rows with a null language
are not learned from. Ties go to the language first in alphabetical order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType,
                               StructField, StructType)

from hearth.llm.common import map_rows, texts

BUCKETS = 1 << 13
CENTROIDS = 4
SAMPLE_ROWS = 1500
KMEANS_ROUNDS = 8
REJECT_QUANTILE = 0.005
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_COUNTS = StructType([StructField("bucket", IntegerType(), False), StructField("df", LongType(), False)])
_SPARSE = StructType([StructField("lang", StringType(), False), StructField("at", ArrayType(IntegerType()), False),
                      StructField("tf", ArrayType(FloatType()), False)])
_CENTRES = StructType([StructField("lang", StringType(), False), StructField("k", IntegerType(), False),
                       StructField("vector", ArrayType(FloatType()), False),
                       StructField("least", DoubleType(), False)])
PREDICTION = StructType([StructField("lang", StringType(), False), StructField("score", DoubleType(), False),
                         StructField("rejected", BooleanType(), False)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's hashed byte 2- and 3-grams: lower case, every run
    of ASCII characters that are no letters is one space."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    codes = np.concatenate([two | np.uint32(1 << 24), three])
    at = (codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(at, minlength=BUCKETS)
    places = np.flatnonzero(counts)
    return places.astype(np.int32), counts[places]


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Over all of ``rows(text)``: how many texts have an n-gram in each place."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        df = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in texts(b["text"]):
                df[gram_counts(t)[0]] += 1
        at = np.flatnonzero(df)
        yield {"bucket": at.astype(np.int32), "df": df[at]}

    summed = map_rows(rows.select("text"), _COUNTS, run).groupBy("bucket").agg(F.sum("df").alias("df"))
    out = np.zeros(BUCKETS, np.int64)
    for r in summed.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["df"]
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Up to ``k`` unit centroids of the unit rows of ``x``, started far from each other."""
    centres = [x.mean(0)]
    centres[0] /= np.linalg.norm(centres[0]) or 1.0
    starts = [int((x @ centres[0]).argmax())]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        far = int(near.argmin())
        if near[far] > 0.999:
            break
        starts.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[starts].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                s = x[own == j].sum(0)
                c[j] = s / (np.linalg.norm(s) or 1.0)
    return c


def _clusterer(idf: np.ndarray):
    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), BUCKETS), np.float32)
        for i, (at, tf) in enumerate(zip(group["at"], group["tf"], strict=True)):
            x[i, at] = tf * idf[at]
        norm = np.linalg.norm(x, axis=1)
        x = x[norm > 0] / norm[norm > 0][:, None]
        if not len(x):
            return pd.DataFrame(columns=_CENTRES.names)
        c = spherical_kmeans(x, CENTROIDS)
        cosine = x @ c.T
        own, best = cosine.argmax(1), cosine.max(1)
        least = [float(np.quantile(best[own == j], REJECT_QUANTILE)) if (own == j).any() else 1.0
                 for j in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(c)), "vector": list(c), "least": least})

    return cluster


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of all languages, one row each, with the least usual cosine."""

    idf: np.ndarray
    langs: tuple[str, ...]
    centres: np.ndarray
    least: np.ndarray

    def identify_text(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, n = gram_counts(text)
        v = (1 + np.log(n)) * self.idf[at]
        cosine = self.centres[:, at] @ v / (np.linalg.norm(v) or 1.0)
        best = int(cosine.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.least[best])

    def identify(self, text: Column) -> Column:
        """Struct of :data:`PREDICTION` for a text column."""
        # at most BUCKETS * CENTROIDS numbers a language
        @F.pandas_udf(PREDICTION)
        def predict(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.identify_text(t) for t in column], columns=PREDICTION.names)

        return predict(text)


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``rows(text, lang)``; rows with a null text or language are passed over. With a
    ``doc_id``, sampled rows are drawn by it."""
    drawn_by = "doc_id" if "doc_id" in rows.columns else "text"
    rows = rows.select("text", "lang", F.xxhash64(drawn_by, F.lit(11)).alias("draw")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # per language
    if not sizes:
        return LanguageModel(np.ones(BUCKETS, np.float32), (), np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    total = sum(sizes.values())
    df = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)
    share = F.lit(1 << 30)
    for lang, n in sizes.items():
        if n > sample_rows:
            share = F.when(F.col("lang") == lang, math.ceil(sample_rows / n * (1 << 30))).otherwise(share)
    # drawn by the document's id, so copies of a text are drawn singly; of rows that repeat an id one is drawn
    sample = rows.where(F.pmod("draw", F.lit(1 << 30)) < share).dropDuplicates(["lang", "draw"])

    def sparse(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [gram_counts(t) for t in texts(b["text"])]
            yield {"lang": b["lang"].to_pylist(), "at": [a for a, _ in found],
                   "tf": [(1 + np.log(n)).astype(np.float32) for _, n in found]}

    centres = (map_rows(sample, _SPARSE, sparse).groupBy("lang").applyInPandas(_clusterer(idf), _CENTRES)
               .orderBy("lang", "k").collect())  # at most CENTROIDS rows a language
    return LanguageModel(idf, tuple(r["lang"] for r in centres),
                         np.array([r["vector"] for r in centres], np.float32).reshape(-1, BUCKETS),
                         np.array([r["least"] for r in centres]))


def language_id(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: ``doc_id``, ``lang_pred``, ``score`` and ``rejected``."""
    out = docs.select("doc_id", model.identify(F.col("text")).alias("_p"))
    return out.select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"),
                      F.col("_p.rejected").alias("rejected"))
