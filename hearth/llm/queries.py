"""The registered query of each corpus operator: the operator over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hearth.llm import (ann, bpe, contamination, langid, licenses, neardup, packing, phrases, quality, sql, toxicity,
                        urls, warc, whitening)
from hearth.llm.common import held_out, read
from hearth.llm.tokens import ByteBpe


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies (the same on every executor)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbers, its posterior of being good and whether it is kept."""
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.STATS[:5], "base_failed", F.round("posterior", 6).alias("posterior"), "kept")


def _digests(tokenizer: ByteBpe, ids: bytes) -> tuple[int, str, str]:
    values = np.frombuffer(ids, "<u4")
    decimal = ",".join(map(str, values.tolist()))
    return (len(values), hashlib.sha256(decimal.encode()).hexdigest(),
            hashlib.sha256(tokenizer.text(values).encode()).hexdigest())


#: Token count, and digests of the ids and of the text decoded from them.
DIGESTS = bpe.Finish(StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                                 StructField("decoded_sha256", StringType())]), _digests)


def op2_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path(), DIGESTS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by centroids learned outside the held-out fold. The
    nearest language stands even where the distance would reject it (``rejected``)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    found = langid.language_id(docs, langid.fit(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by host rule, else by mined rules."""
    found = urls.filter_urls(read(spark, sf_dir, "pages"))
    return found.withColumn("confidence", F.round("confidence", 6))


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records from ``pages``: each row is a capture of its whole url with a time, and three
    later or simultaneous 304 answers; and the same for the url of its site section (host and first
    path segment), which pages share."""
    base = F.lit(1_700_000_000) + F.col("page_id") * 600
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 12), F.lit('"'))

    def record(n: int, kind: str, after: int, status: int, payload, *headers) -> F.Column:
        pairs = [x for name, value in headers for x in (F.lit(name), F.col(value) if isinstance(value, str) else value)]
        return F.struct((F.col("page_id") * 8 + n).alias("number"), F.lit(kind).alias("kind"),
                        (base + after).alias("ts"), F.lit(status).alias("status"),
                        F.create_map(*pairs).alias("headers"), payload.alias("payload"))

    none = F.lit(None).cast("string")
    at = [(base + a).cast("string") for a in (0, 60, 3000)]
    records = F.array(
        record(0, "response", 0, 200, F.col("html"), ("Content-Type", F.lit("text/html")), ("ETag", tag),
               ("Last-Modified", at[0]), ("Date", at[0]), ("Cache-Control", F.lit("max-age=60")),
               ("Content-Length", F.length("html").cast("string"))),
        record(1, "revisit", 60, 304, none, ("ETag", F.concat(F.lit("W/"), tag)), ("Date", at[1]),
               ("Cache-Control", F.lit("max-age=600")), ("Content-Length", F.lit("0"))),
        record(2, "revisit", 3000, 304, none, ("Last-Modified", at[0]), ("Date", at[2]), ("X-Cache", F.lit("hit"))),
        record(3, "revisit", 0, 304, none, ("ETag", tag)))
    section = F.regexp_extract("url", "^[^:]*://[^/?#]*/[^/?#]*", 0)
    urls = F.explode(F.array(F.struct(F.col("url"), F.lit(0).alias("of")), F.struct(section.alias("url"), F.lit(4).alias("of"))))
    rows = pages.select(F.struct("page_id", "html").alias("p"), urls.alias("u")).select("p.*", "u.*")
    return rows.select("url", "of", F.explode(records).alias("r")).select(
        "url", (F.col("r.number") + F.col("of")).alias("record_id"), "r.kind", "r.ts", "r.status", "r.headers", "r.payload")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 304 capture of the pages' urls and of their sections, resolved to its response."""
    found = warc.resolve_revisits(page_captures(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    line = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "outcome", "response_id",
                        F.when(F.col("headers").isNotNull(), F.array_join(line, "\n")).alias("headers"), "payload_digest")


def op6_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector with an id divisible by 20, by inner product."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, one row per piece."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """The model learned from ``docs`` outside the held-out fold and their labels."""
    rows = toxicity.training_rows(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.fit(spark, rows)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's known licence sentences and licences, in text order."""
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", " ").alias("sentences"),
                        F.array_join("licenses", " ").alias("licenses"), "license")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best collocations of two and three words."""
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in windows of benchmark items, and those items."""
    found = contamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 8 components, scaled to variance 1."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_bpe_chunk_reuse, op3_language_id, op4_url_rules, op5_warc_revisits,
    op6_collision_counting_ann, op7_best_fit_packing, op8_toxicity, op9_license_scan, op10_minhash_near_dedup,
    op11_toivonen_phrases, op12_positional_index, op13_exact_whitening)}

#: The other operators are held against brute force, a round trip or held-out accuracy in tests.
SQL: dict[str, str] = {"op1_quality_rules": sql.quality_sql(), "op4_url_rules": sql.urls_sql(),
                       "op5_warc_revisits": sql.warc_sql(), "op9_license_scan": sql.licenses_sql(),
                       "op11_toivonen_phrases": sql.phrases_sql(), "op12_positional_index": sql.contamination_sql()}
