"""Catalog: operators by group on tables whose group and category columns hold
NULLs (made on purpose, the tables have none). A NULL group is a group of its
own; a NULL category is in no category."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.catalog.common import ni
from hearth.catalog.registry import query
from hearth.catalog.sqlfrag import HH, IND, NI
from hearth.operators import encode, joins, profile

_N = f"""WITH {HH},\n{IND},\n{NI},
nz AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE country END AS country, poor,
  CASE WHEN id % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg,
  CASE WHEN id % 11 = 0 THEN NULL ELSE num_indiv END AS num_indiv FROM ni)"""

_STATS = """, st AS (SELECT country, avg(num_indiv) AS m, stddev_samp(num_indiv) AS s, min(num_indiv) AS lo,
  max(num_indiv) AS hi, count(*) AS tot FROM nz GROUP BY country)"""
_JOIN = "nz JOIN st ON nz.country IS NOT DISTINCT FROM st.country"


def _nz(spark, sf):
    return ni(spark, sf).select(
        "id", F.when(F.col("id") % 6 != 0, F.col("country")).alias("country"), "poor",
        F.when(F.col("id") % 5 != 0, F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("id") % 11 != 0, F.col("num_indiv")).alias("num_indiv"))


@query("a4_median_null_group", _N + """
SELECT country, 'num_indiv' AS "column", avg(num_indiv) AS mean, quantile_cont(num_indiv, 0.5) AS median
FROM nz GROUP BY country""", round_cols=["mean", "median"])
def a4_null(spark, sf):
    """A4 by a country that may be NULL."""
    return profile.mean_median(_nz(spark, sf), ["num_indiv"], by=["country"])


@query("a5_nunique_null_group", _N + """
SELECT country, 'seg' AS "column", count(DISTINCT seg) AS nunique FROM nz GROUP BY country""")
def a5_null(spark, sf):
    """A5 by a country that may be NULL."""
    return profile.nunique(_nz(spark, sf), ["seg"], by=["country"])


@query("a13_share_null_group", _N + _STATS + f"""
SELECT nz.country, poor, seg, count(*) AS n, count(*) / any_value(tot) * 100 AS pct FROM {_JOIN}
GROUP BY nz.country, poor, seg""", round_cols=["pct"])
def a13_null(spark, sf):
    """A13 by a country that may be NULL."""
    return profile.class_category_share(_nz(spark, sf), "seg", "poor", by=["country"])


@query("a14_kde_null_group", _N + """,
t AS (SELECT country, poor, CAST(num_indiv AS DOUBLE) AS x FROM nz WHERE poor IS NOT NULL AND num_indiv IS NOT NULL),
g AS (SELECT country, poor, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM t GROUP BY country, poor),
r AS (SELECT country, min(x) AS lo, max(x) AS hi FROM t GROUP BY country)
SELECT t.country, t.poor, CAST(i AS INTEGER) AS grid_index, lo + (hi - lo) / 3 * i AS x,
  CASE WHEN any_value(h) > 0 THEN sum(exp(-0.5 * pow((lo + (hi - lo) / 3 * i - t.x) / h, 2)))
    / (any_value(n) * any_value(h) * sqrt(2 * pi())) END AS density
FROM t JOIN g ON t.country IS NOT DISTINCT FROM g.country AND t.poor = g.poor
  JOIN r ON t.country IS NOT DISTINCT FROM r.country, range(4) AS k(i)
GROUP BY t.country, t.poor, i, lo, hi""", round_cols=["x", "density"])
def a14_null(spark, sf):
    """A14 by a country that may be NULL."""
    return profile.class_kde(_nz(spark, sf), "num_indiv", "poor", grid_size=4, by=["country"])


@query("a16_frequency_null_group", _N + _STATS + f"""
SELECT nz.country, seg, count(*) AS n, count(*) / any_value(tot) AS freq FROM {_JOIN}
GROUP BY nz.country, seg""", round_cols=["freq"])
def a16_null(spark, sf):
    """A16 by a country that may be NULL."""
    return profile.category_frequency(_nz(spark, sf), "seg", by=["country"])


@query("p19_outliers_null_group", _N + _STATS + f"""
SELECT nz.* FROM {_JOIN} WHERE num_indiv IS NULL OR s IS NULL OR s = 0 OR abs(num_indiv - m) <= s""")
def p19_null(spark, sf):
    """P19 by a country that may be NULL."""
    return profile.zscore_outliers(_nz(spark, sf), ["num_indiv"], k=1.0, by=["country"])


@query("e1_standardize_null_group", _N + _STATS + f"""
SELECT nz.* REPLACE ((num_indiv - m) / nullif(s, 0) AS num_indiv) FROM {_JOIN}""", round_cols=["num_indiv"])
def e1_null(spark, sf):
    """E1 by a country that may be NULL."""
    return encode.standardize(_nz(spark, sf), ["num_indiv"], by=["country"])


@query("e2_min_max_null_group", _N + _STATS + f"""
SELECT nz.* REPLACE (CASE WHEN hi = lo AND num_indiv IS NOT NULL THEN 0.0 ELSE CAST(num_indiv - lo AS DOUBLE) / (hi - lo) END
  AS num_indiv) FROM {_JOIN}""", round_cols=["num_indiv"])
def e2_null(spark, sf):
    """E2 by a country that may be NULL."""
    return encode.min_max_scale(_nz(spark, sf), ["num_indiv"], by=["country"])


@query("e8_fill_mean_null_group", _N + _STATS + f"""
SELECT nz.* REPLACE (coalesce(CAST(num_indiv AS DOUBLE), m) AS num_indiv) FROM {_JOIN}""", round_cols=["num_indiv"])
def e8_null(spark, sf):
    """E8 by a country that may be NULL."""
    return encode.fill_mean(_nz(spark, sf), ["num_indiv"], by=["country"])


@query("j5_stats_null_group", _N + _STATS + f"""
SELECT nz.*, m AS mean, tot AS n FROM {_JOIN}""", round_cols=["mean"])
def j5_null(spark, sf):
    """J5 by a country that may be NULL."""
    z = _nz(spark, sf)
    return joins.attach_stats(z, z.groupBy("country").agg(F.avg("num_indiv").alias("mean"), F.count("*").alias("n")),
                              by=["country"])


@query("e12_target_mean_null_category", _N + """,
tm AS (SELECT seg, avg(CAST(poor AS DOUBLE)) AS v FROM nz WHERE seg IS NOT NULL GROUP BY seg)
SELECT nz.* REPLACE (tm.v AS seg) FROM nz LEFT JOIN tm ON nz.seg = tm.seg""", round_cols=["seg"])
def e12_null(spark, sf):
    """J4/E12 on a category that may be NULL: it maps to NULL."""
    z = _nz(spark, sf)
    return encode.target_mean_encode(z, ["seg"]).select(*z.columns)


@query("e14_frequency_null_category", _N + """,
f AS (SELECT seg, count(*) / (SELECT count(*) FROM nz) AS v FROM nz WHERE seg IS NOT NULL GROUP BY seg)
SELECT nz.* REPLACE (coalesce(f.v, 0) AS seg) FROM nz LEFT JOIN f ON nz.seg = f.seg""", round_cols=["seg"])
def e14_null(spark, sf):
    """E14 on a category that may be NULL: it maps to 0."""
    z = _nz(spark, sf)
    return encode.frequency_encode(z, "seg").select(*z.columns)
