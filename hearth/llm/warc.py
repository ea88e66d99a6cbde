"""Resolution of not-modified revisits in web archives.

A revisit record says "304 Not Modified" and has no payload. It is resolved to
the latest earlier full response (status 200 with a payload) of the same
canonical URL: the validators of both have to agree, then the stored headers
are updated with those headers that a 304 may update, and the payload is that
of the response.

The as-of join works on moments, not records: all records of one URL in one
second are a single row, so an hour of one URL has at most 3600 rows. Within
the hour a window finds the latest earlier response; the last responses of the
hours are carried forward within months (at most 720 rows), and those of the
months between them (12 rows a year). A URL that holds a third of all records
is thus spread over its hours, and equal moments are summed before the shuffle. Payloads are not shuffled: their digest
is taken where they are read.

``records``: ``record_id`` long, ``kind`` (``response`` or ``revisit``), ``url``,
``ts`` (seconds, long), ``status`` int, ``headers`` map, ``payload`` string.

Defined cases: a response of the revisit's own second is not earlier. Of several
responses in one second the one with the largest id counts. A revisit without
URL or time, or without an earlier full response, is ``no_response``. If neither
ETag nor Last-Modified is on both sides it is ``no_validator``; if the ETags (or
without them the dates) differ it is ``changed``; both get no headers and no
payload. Header names are case-insensitive; of names that differ in case only
the least value stays. A repeated revisit row gives a row each; records of one
id are expected to be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import staged

#: Seconds of an hour, hours of a month.
SPANS = (3600, 720)

#: Headers of a 304 that update the stored ones (fixed values).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host and rest of a URL without scheme, leading ``www.``, default port and
    fragment; the host in lower case; an empty path is ``/``. Null without ``://``."""
    rest = F.regexp_replace(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    tail = F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?]*", 0)) + 1, F.length(rest))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(F.instr(url, "://") > 0, F.concat(host, tail))


def _lower_names(headers: Column) -> Column:
    """Sorted ``(name, value)`` entries with names in lower case, one per name."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                                       lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    first = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]))
    return F.map_from_entries(first)


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def earlier_responses(moments: DataFrame) -> DataFrame:
    """``moments(url_key, ts, response_id)``, unique by ``(url_key, ts)``, with
    ``earlier_id``: the response of the latest earlier moment that has one."""
    found = _latest_before(moments.select("url_key", F.col("ts").alias("at"), "response_id"), SPANS)
    return found.select("url_key", F.col("at").alias("ts"), F.col("before").alias("earlier_id"))


def _latest_before(rows: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """``rows(url_key, at, response_id)`` with ``before``: the last id at an earlier ``at`` of
    the URL. The last id inside the row's span, else the last one of an earlier span."""
    earlier = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    if not spans:
        return rows.withColumn("before", F.last("response_id", ignorenulls=True).over(earlier.partitionBy("url_key")))
    rows = rows.withColumn("span", F.floor(F.col("at") / spans[0]))
    ends = rows.groupBy("url_key", F.col("span").alias("at")).agg(
        F.max(F.when(F.col("response_id").isNotNull(), F.struct("at", "response_id")))["response_id"].alias("response_id"))
    carried = _latest_before(ends, spans[1:]).select("url_key", F.col("at").alias("span"), F.col("before").alias("carried"))
    near = rows.withColumn("near", F.last("response_id", ignorenulls=True).over(earlier.partitionBy("url_key", "span")))
    return near.join(carried, ["url_key", "span"]).select(
        "url_key", "at", "response_id", F.coalesce("near", "carried").alias("before"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record: ``record_id``, ``outcome`` (``resolved``, ``changed``,
    ``no_validator`` or ``no_response``), ``response_id``, ``headers`` (merged) and
    ``payload_digest`` (SHA-256 of the response's payload)."""
    slim = staged(records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
        (F.coalesce(F.col("status") == 200, F.lit(False)) & F.col("payload").isNotNull()).alias("full"),
        _lower_names(F.col("headers")).alias("headers"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest")), "records")
    full = slim.where((F.col("kind") == "response") & F.col("full"))
    revisits = slim.where(F.col("kind") == "revisit").select("record_id", "url_key", "ts", "headers")
    moments = (slim.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull()
                          & (F.col("full") | (F.col("kind") == "revisit")))
               .groupBy("url_key", "ts")
               .agg(F.max(F.when((F.col("kind") == "response") & F.col("full"), F.col("record_id"))).alias("response_id")))
    earlier = earlier_responses(moments)
    stored = full.select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"),
                         "payload_digest").dropDuplicates(["response_id"])
    found = (revisits.join(earlier, ["url_key", "ts"], "left")
             .withColumnRenamed("earlier_id", "response_id").join(stored, "response_id", "left"))
    own, old = F.col("headers"), F.col("stored")
    same = F.when(own["etag"].isNotNull() & old["etag"].isNotNull(), _etag(own) == _etag(old)).when(
        own["last-modified"].isNotNull() & old["last-modified"].isNotNull(), own["last-modified"] == old["last-modified"])
    outcome = (F.when(old.isNull(), "no_response").when(same.isNull(), "no_validator")
               .when(same, "resolved").otherwise("changed"))
    update = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    done = outcome == "resolved"
    return found.select("record_id", outcome.alias("outcome"), F.col("response_id"),
                        F.when(done, F.map_concat(kept, update)).alias("headers"),
                        F.when(done, F.col("payload_digest")).alias("payload_digest"))
