"""Catalog: profiling (A1-A16) and feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.catalog.common import hh, ind, ni
from hearth.catalog.registry import query
from hearth.catalog.sqlfrag import BASE, DOCS, HH, IND, NI
from hearth.operators import encode, metrics, profile, schema
from hearth.sources import tables

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NATIONS = sorted((str(n) for n in range(25)))


def _union_per_column(cols, template):
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


def _li(spark, sf):
    return tables.read_table(spark, sf, "lineitem")


def _train(df):
    return df.where(F.col("_split") == "train")


# ------------------------------------------------------------------ profiling

@query("a1_count_per_key", f"WITH {IND} SELECT id, count(*) AS n FROM ind GROUP BY id")
def a1(spark, sf):
    """A1: individuals per household key."""
    return profile.count_per_key(ind(spark, sf), "id")


@query("a2_mean_std", _union_per_column(
    LI_NUM, "SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std FROM lineitem"),
    round_cols=["mean", "std"])
def a2(spark, sf):
    """A2: column mean and sample std (long form)."""
    return profile.column_stats(_li(spark, sf), LI_NUM).select("column", "n", "mean", "std")


@query("a3_min_max", _union_per_column(
    LI_NUM, "SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max FROM lineitem"),
    round_cols=["min", "max"])
def a3(spark, sf):
    """A3: column min and max (long form)."""
    return profile.column_stats(_li(spark, sf), LI_NUM).select("column", "min", "max")


@query("a4_mean_median", _union_per_column(
    LI_NUM, "SELECT '{c}' AS \"column\", avg({c}) AS mean, quantile_cont({c}, 0.5) AS median FROM lineitem"),
    round_cols=["mean", "median"])
def a4(spark, sf):
    """A4: mean and exact median per column (distributed rank, no value buffer)."""
    return profile.mean_median(_li(spark, sf), LI_NUM)


@query("a4_median_by_country", f"WITH {HH},\n{IND},\n{NI}\n" + _union_per_column(
    ["num_indiv", "c_nationkey"],
    "SELECT country, '{c}' AS \"column\", avg({c}) AS mean, quantile_cont({c}, 0.5) AS median "
    "FROM ni GROUP BY country"), round_cols=["mean", "median"])
def a4_by(spark, sf):
    """A4 per group: mean and exact median of household columns per country."""
    return profile.mean_median(ni(spark, sf), ["num_indiv", "c_nationkey"], by=["country"])


@query("a5_nunique", f"WITH {HH}\n" + _union_per_column(
    ["country", "poor", "c_mktsegment", "c_nationkey"],
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM hh"))
def a5(spark, sf):
    """A5: distinct non-null values per column."""
    return profile.nunique(hh(spark, sf), ["country", "poor", "c_mktsegment", "c_nationkey"])


@query("a6_null_profile", f"WITH {HH}\n" + _union_per_column(
    ["poor", "c_mktsegment", "c_nationkey"],
    "SELECT '{c}' AS \"column\", count(*) AS n_rows, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    "AS n_null, sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*) AS null_share FROM hh"),
    round_cols=["null_share"])
def a6(spark, sf):
    """NULL counts and shares per column (test rows have no target)."""
    return profile.null_profile(hh(spark, sf), ["poor", "c_mktsegment", "c_nationkey"])


@query("a7_constant_columns", f"WITH {HH}, t AS (" + _union_per_column(
    ["country", "c_mktsegment", "source"],
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM (SELECT *, 'survey' AS source FROM hh)")
    + ") SELECT * FROM t WHERE nunique <= 1")
def a7(spark, sf):
    """Columns with a single value."""
    h = schema.add_constant(hh(spark, sf), "source", "survey")
    return profile.constant_columns(h, ["country", "c_mktsegment", "source"])


@query("a8_high_cardinality", f"WITH {HH}, t AS (" + _union_per_column(
    ["country", "c_mktsegment", "c_nationkey"],
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM hh") + ") SELECT * FROM t WHERE nunique > 10")
def a8(spark, sf):
    """Categorical columns with more than 10 values."""
    h = schema.stringify_columns(hh(spark, sf), ["c_nationkey"], null_as=None)
    return profile.high_cardinality(h, ["country", "c_mktsegment", "c_nationkey"], 10)


_PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]


@query("a9_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM lineitem" for a, b in _PAIRS),
    round_cols=["corr"])
def a9(spark, sf):
    """Pearson correlation of every numeric column pair."""
    return profile.correlation(_li(spark, sf), LI_NUM)


_OVERLAP_SQL = BASE + """,
lf AS (SELECT 'num_indiv' AS "column", CAST(num_indiv AS DOUBLE) AS value, CAST(poor AS INTEGER) AS y FROM ni
       WHERE _split = 'train'
       UNION ALL
       SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE), CAST(poor AS INTEGER) FROM ni WHERE _split = 'train'),
rng AS (SELECT "column", min(value) AS mn, max(value) AS mx, sum(y) AS tot1, sum(1 - y) AS tot0
        FROM lf GROUP BY 1),
h AS (SELECT lf."column", CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / (mx - mn) * 10), 9) END AS bin,
             sum(y) AS c1, sum(1 - y) AS c0, any_value(tot1) AS t1, any_value(tot0) AS t0
      FROM lf JOIN rng USING ("column") GROUP BY 1, 2),
ov AS (SELECT "column", sum(least(c0 / t0, c1 / t1)) AS overlap FROM h GROUP BY 1),
d AS (SELECT "column", value, sum(y) AS p, sum(1 - y) AS q FROM lf GROUP BY 1, 2),
c AS (SELECT "column", sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM d
      WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kst AS (SELECT c."column", max(abs(cp / tot1 - cq / tot0)) AS ks FROM c JOIN rng USING ("column") GROUP BY 1)
SELECT ov."column", ov.overlap, kst.ks FROM ov JOIN kst USING ("column")"""


#: A hundred numeric columns of the order lines.
_WIDE = {f"x{i}": f"(l_quantity * {i + 1}) % {7 + i} + l_discount * {i % 5} + l_extendedprice * {i % 3} / 1000" for i in range(100)}


@query("a9_correlation_wide", "WITH w AS (SELECT " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items()) + " FROM lineitem),\nr AS (SELECT " + ", ".join(
    f"corr(x{i}, x{j}) AS c{i}_{j}" for i in range(100) for j in range(i + 1, 100)) + " FROM w)\n"
    "SELECT split_part(name, '_', 1) AS col_a, split_part(name, '_', 2) AS col_b, corr FROM (SELECT "
    "'x' || replace(substr(name, 2), '_', '_x') AS name, corr FROM (UNPIVOT r ON COLUMNS(*) INTO NAME name VALUE corr))",
    round_cols=["corr"])
def a9_wide(spark, sf):
    """A9 over a hundred columns: all pairs from the Gram matrices of row blocks, in one pass."""
    li = tables.read_table(spark, sf, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items()])
    return profile.correlation(li, list(_WIDE), method="matrix")


@query("a10_class_overlap", _OVERLAP_SQL, round_cols=["overlap", "ks"])
def a10(spark, sf):
    """A10: class separation per feature: histogram overlap and exact KS."""
    return profile.class_overlap(_train(ni(spark, sf)), ["num_indiv", "c_nationkey"], "poor", n_bins=10)


@query("a11_target_ratio", f"WITH {HH} SELECT country, avg(CAST(poor AS INTEGER)) * 100 AS pct_positive FROM hh "
       "WHERE _split = 'train' GROUP BY country", round_cols=["pct_positive"])
def a11(spark, sf):
    """Percent of positive households per country."""
    return profile.target_ratio(_train(hh(spark, sf)))


@query("a12_class_counts", f"WITH {HH} SELECT country, poor, count(*) AS n FROM hh WHERE _split = 'train' "
       "GROUP BY country, poor")
def a12(spark, sf):
    """Households per class and country."""
    return profile.class_counts(_train(hh(spark, sf)))


@query("a13_class_category_share", f"""WITH {HH},
t AS (SELECT * FROM hh WHERE _split = 'train')
SELECT country, poor, c_mktsegment, count(*) AS n,
       count(*) / any_value(tot) * 100 AS pct
FROM t JOIN (SELECT country, count(*) AS tot FROM t GROUP BY country) USING (country)
GROUP BY country, poor, c_mktsegment""", round_cols=["pct"])
def a13(spark, sf):
    """Percent of a country's households in each (class, category) cell."""
    return profile.class_category_share(_train(hh(spark, sf)), "c_mktsegment")


_KDE_G = 16
_KDE_SQL = BASE + f""",
t AS (SELECT country, poor, CAST(num_indiv AS DOUBLE) AS x FROM ni WHERE _split = 'train'),
st AS (SELECT country, poor, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h,
              min(x) AS mn, max(x) AS mx FROM t GROUP BY 1, 2),
g AS (SELECT country, poor, n, h, min(mn) OVER (PARTITION BY country) AS gmin,
             max(mx) OVER (PARTITION BY country) AS gmax FROM st),
grid AS (SELECT range AS i FROM range({_KDE_G}))
SELECT g.country, g.poor, CAST(grid.i AS INTEGER) AS grid_index,
       g.gmin + (g.gmax - g.gmin) / {_KDE_G - 1} * grid.i AS x,
       sum(exp(-0.5 * pow((g.gmin + (g.gmax - g.gmin) / {_KDE_G - 1} * grid.i - t.x) / g.h, 2)))
         / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) AS density
FROM g JOIN t ON g.country = t.country AND g.poor = t.poor, grid
GROUP BY g.country, g.poor, grid.i, g.gmin, g.gmax"""


@query("a14_class_kde", _KDE_SQL, round_cols=["x", "density"])
def a14(spark, sf):
    """Per-class Gaussian KDE of num_indiv on a 16-point grid, per country."""
    return profile.class_kde(_train(ni(spark, sf)), "num_indiv", "poor", grid_size=_KDE_G, by=["country"])


@query("a15_group_target_mean", f"WITH {HH} SELECT c_mktsegment, avg(CAST(poor AS DOUBLE)) AS target_mean, "
       "count(*) AS n FROM hh WHERE _split = 'train' GROUP BY c_mktsegment", round_cols=["target_mean"])
def a15(spark, sf):
    """Mean target per category."""
    return profile.group_target_mean(_train(hh(spark, sf)), "c_mktsegment")


@query("a16_category_frequency", f"""WITH {HH}
SELECT country, c_mktsegment, count(*) AS n, count(*) / any_value(tot) AS freq
FROM hh JOIN (SELECT country, count(*) AS tot FROM hh GROUP BY country) USING (country)
GROUP BY country, c_mktsegment""", round_cols=["freq"])
def a16(spark, sf):
    """Category shares per country."""
    return profile.category_frequency(hh(spark, sf), "c_mktsegment", by=["country"])


# ------------------------------------------------------------------ encoders

@query("e1_standardize_own", f"""WITH {HH},\n{IND},\n{NI}
SELECT * REPLACE ((num_indiv - avg(num_indiv) OVER w) / nullif(stddev_samp(num_indiv) OVER w, 0) AS num_indiv)
FROM ni WINDOW w AS (PARTITION BY _split, country)""", round_cols=["num_indiv"])
def e1(spark, sf):
    """Standardise with each split's (and country's) own statistics (reference parity)."""
    return encode.standardize(ni(spark, sf), ["num_indiv"], by=["_split", "country"])


@query("e1_standardize_fit_on_train", f"""WITH {HH},\n{IND},\n{NI},
st AS (SELECT country, avg(num_indiv) AS m, stddev_samp(num_indiv) AS s FROM ni WHERE _split = 'train' GROUP BY 1)
SELECT ni.* REPLACE ((num_indiv - m) / nullif(s, 0) AS num_indiv) FROM ni JOIN st USING (country)""",
       round_cols=["num_indiv"])
def e1_fit(spark, sf):
    """E1 ``fit_on_train``: train statistics per country applied to every row."""
    return encode.standardize(ni(spark, sf), ["num_indiv"], by=["country"], fit_on=F.col("_split") == "train")


@query("e2_min_max", f"""WITH {HH},\n{IND},\n{NI},
st AS (SELECT min(num_indiv) AS a, max(num_indiv) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d FROM ni)
SELECT ni.* REPLACE (CASE WHEN b = a THEN 0.0 ELSE (num_indiv - a) / (b - a) END AS num_indiv,
                     CASE WHEN d = c THEN 0.0 ELSE (c_nationkey - c) / (d - c) END AS c_nationkey)
FROM ni, st""", round_cols=["num_indiv", "c_nationkey"])
def e2(spark, sf):
    """Min-max scaling (constant column -> 0)."""
    return encode.min_max_scale(ni(spark, sf), ["num_indiv", "c_nationkey"])


@query("e3_label_encode", f"""WITH {HH}
SELECT hh.* REPLACE (CAST(v.code AS INTEGER) AS c_mktsegment) FROM hh
JOIN (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code
      FROM (SELECT DISTINCT c_mktsegment FROM hh)) v USING (c_mktsegment)""")
def e3(spark, sf):
    """Label encoding by sorted distinct value."""
    return encode.label_encode(hh(spark, sf), ["c_mktsegment"])


def _dummies(col, values, src=None):
    s = src or col
    return ", ".join(f"CASE WHEN CAST({s} AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS {col}_{v}" for v in values)


@query("e4_one_hot", f"WITH {HH} SELECT id, country, poor, c_nationkey, _split, {_dummies('c_mktsegment', SEGMENTS)} "
       "FROM hh")
def e4(spark, sf):
    """``get_dummies`` of a string column."""
    return encode.one_hot(hh(spark, sf), ["c_mktsegment"])


@query("e5_joint_encode", f"WITH {HH} SELECT id, _split, {_dummies('c_mktsegment', SEGMENTS)}, "
       f"{_dummies('c_nationkey', NATIONS)} FROM hh")
def e5(spark, sf):
    """E5: train and test concatenated with a tag, one vocabulary over both, encoded (the tag stays for the split back)."""
    tr = schema.stringify_columns(
        hh(spark, sf).where(F.col("_split") == "train").select("id", "c_mktsegment", "c_nationkey"), ["c_nationkey"])
    te = schema.stringify_columns(
        hh(spark, sf).where(F.col("_split") == "test").select("id", "c_mktsegment", "c_nationkey"), ["c_nationkey"])
    return encode.joint_one_hot(tr, te, ["c_mktsegment", "c_nationkey"])


@query("e6_encode_all_but", f"WITH {HH},\n{IND},\n{NI}\nSELECT id, country, poor, _split, num_indiv, "
       f"{_dummies('c_nationkey', NATIONS)} FROM ni")
def e6(spark, sf):
    """Drop string categoricals, then one-hot every column except the
    numeric list (the country B recipe)."""
    h = schema.drop_categoricals(ni(spark, sf))
    return encode.encode_all_but(h, numeric=["num_indiv"])


_NULLED = f"""WITH {HH},\n{IND},\n{NI},
z AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE c_nationkey END AS nation,
             CASE WHEN id % 5 = 0 THEN NULL ELSE num_indiv END AS num_indiv FROM ni)"""


def _nulled(spark, sf):
    """Household columns with NULLs made on purpose (the tables have none)."""
    return ni(spark, sf).select(
        "id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("c_nationkey")).alias("nation"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("num_indiv")).alias("num_indiv"))


@query("e7_fill_zero", _NULLED + "\nSELECT id, coalesce(nation, 0) AS nation, coalesce(num_indiv, 0) AS num_indiv FROM z")
def e7(spark, sf):
    """NULL -> 0."""
    return encode.fill_zero(_nulled(spark, sf), ["nation", "num_indiv"])


@query("e8_fill_mean", _NULLED + """
SELECT id, coalesce(CAST(nation AS DOUBLE), (SELECT avg(nation) FROM z)) AS nation,
       coalesce(CAST(num_indiv AS DOUBLE), (SELECT avg(num_indiv) FROM z)) AS num_indiv FROM z""",
       round_cols=["nation", "num_indiv"])
def e8(spark, sf):
    """NULL -> column mean (the filled column is double)."""
    return encode.fill_mean(_nulled(spark, sf), ["nation", "num_indiv"])


@query("e8_fill_mean_compat", _NULLED + """
SELECT id, coalesce(CAST(nation AS DOUBLE), (SELECT avg(nation) FROM z)) AS nation,
       coalesce(CAST(num_indiv AS DOUBLE), (SELECT avg(nation) FROM z)) AS num_indiv FROM z""",
       round_cols=["nation", "num_indiv"])
def e8_compat(spark, sf):
    """E8 compat: every column filled with the first column's mean (reference loop)."""
    return encode.fill_mean(_nulled(spark, sf), ["nation", "num_indiv"], compat=True)


@query("e9_fill_median", _NULLED + """
SELECT id, coalesce(CAST(nation AS DOUBLE), (SELECT quantile_cont(nation, 0.5) FROM z)) AS nation,
       coalesce(CAST(num_indiv AS DOUBLE), (SELECT quantile_cont(num_indiv, 0.5) FROM z)) AS num_indiv FROM z""",
       round_cols=["nation", "num_indiv"])
def e9(spark, sf):
    """NULL -> exact column median."""
    return encode.fill_median(_nulled(spark, sf), ["nation", "num_indiv"])


@query("e10_log", f"""WITH {IND}
SELECT id, iid, CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END AS log_price,
       CASE WHEN iid % 4 - 1 > 0 THEN ln(iid % 4 - 1) END AS log_small FROM ind""",
       round_cols=["log_price", "log_small"])
def e10(spark, sf):
    """Natural log with a guard for values <= 0 (-1, 0 and positives occur)."""
    i = ind(spark, sf).select("id", "iid", F.col("o_totalprice").alias("log_price"),
                              (F.col("iid") % 4 - 1).alias("log_small"))
    return encode.log_transform(encode.log_transform(i, "log_price"), "log_small")


@query("e11_bin", f"""WITH {HH},\n{IND},\n{NI}
SELECT id, num_indiv, CASE WHEN num_indiv > 0 AND num_indiv <= 3 THEN '0-3'
  WHEN num_indiv > 3 AND num_indiv <= 5 THEN '3-5' WHEN num_indiv > 5 AND num_indiv <= 10 THEN '5-10'
  WHEN num_indiv > 10 AND num_indiv <= 13 THEN '10-13' WHEN num_indiv > 13 AND num_indiv <= 20 THEN '16+'
  END AS num_indiv_bin FROM ni""")
def e11(spark, sf):
    """Right-closed bins of num_indiv (above 20 -> NULL)."""
    return encode.bin_column(ni(spark, sf).select("id", "num_indiv"), "num_indiv", out="num_indiv_bin")


@query("e12_target_mean_encode", f"""WITH {HH},
a AS (SELECT c_mktsegment, avg(CAST(poor AS DOUBLE)) AS m FROM hh WHERE _split = 'train' GROUP BY 1),
b AS (SELECT c_nationkey, avg(CAST(poor AS DOUBLE)) AS m FROM hh WHERE _split = 'train' GROUP BY 1)
SELECT hh.id, hh.country, hh.poor, hh._split, a.m AS c_mktsegment, b.m AS c_nationkey
FROM hh LEFT JOIN a ON hh.c_mktsegment = a.c_mktsegment LEFT JOIN b ON hh.c_nationkey = b.c_nationkey""",
       round_cols=["c_mktsegment", "c_nationkey"])
def e12(spark, sf):
    """Mean target encoding fitted on train, applied to train and test."""
    return encode.target_mean_encode(hh(spark, sf), ["c_mktsegment", "c_nationkey"],
                                     fit_on=F.col("_split") == "train")


@query("e13_smoothed_target_encode", f"""WITH {HH},
pr AS (SELECT avg(CAST(poor AS DOUBLE)) AS prior FROM hh WHERE _split = 'train'),
st AS (SELECT c_nationkey, count(*) AS n, avg(CAST(poor AS DOUBLE)) AS m FROM hh WHERE _split = 'train' GROUP BY 1),
enc AS (SELECT c_nationkey, prior * (1 - 1 / (1 + exp(-(n - 20) / 10.0)))
                            + m * (1 / (1 + exp(-(n - 20) / 10.0))) AS e FROM st, pr)
SELECT hh.id, hh.country, hh.poor, hh.c_mktsegment, hh._split, coalesce(enc.e, pr.prior) AS nation_te
FROM hh LEFT JOIN enc ON hh.c_nationkey = enc.c_nationkey, pr""", round_cols=["nation_te"])
def e13(spark, sf):
    """Smoothed target encoding (min_samples_leaf=20, smoothing=10, no noise)."""
    return encode.smoothed_target_encode(hh(spark, sf), "c_nationkey", min_samples_leaf=20, smoothing=10,
                                         fit_on=F.col("_split") == "train", out="nation_te").drop("c_nationkey")


@query("e14_frequency_encode", f"""WITH {HH},
f AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM hh WHERE _split = 'train') AS fr
      FROM hh WHERE _split = 'train' GROUP BY 1)
SELECT hh.* EXCLUDE (c_mktsegment), coalesce(f.fr, 0.0) AS seg_freq
FROM hh LEFT JOIN f ON hh.c_mktsegment = f.c_mktsegment""", round_cols=["seg_freq"])
def e14(spark, sf):
    """Category -> share of train rows."""
    return encode.frequency_encode(hh(spark, sf), "c_mktsegment", fit_on=F.col("_split") == "train",
                                   out="seg_freq").drop("c_mktsegment")


@query("e15_preprocess", f"""WITH {HH},\n{IND},\n{NI},
t AS (SELECT id, c_mktsegment, c_nationkey, num_indiv, _split FROM ni WHERE _split = 'train')
SELECT id, _split,
  coalesce((c_nationkey - avg(c_nationkey) OVER ()) / nullif(stddev_samp(c_nationkey) OVER (), 0), 0) AS c_nationkey,
  coalesce((num_indiv - avg(num_indiv) OVER ()) / nullif(stddev_samp(num_indiv) OVER (), 0), 0) AS num_indiv,
  {_dummies('c_mktsegment', SEGMENTS)}
FROM t""", round_cols=["c_nationkey", "num_indiv"])
def e15(spark, sf):
    """The composite pre-processing (standardise, get_dummies, fill 0)."""
    t = _train(ni(spark, sf)).select("id", "c_mktsegment", "c_nationkey", "num_indiv", "_split")
    return encode.preprocess(t, normalize_num="standardize", categorical="get_dummies", fillmean=None)


_E15 = f"""WITH {HH},\n{IND},\n{NI},
t AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg, _split,
  CASE WHEN id % 5 = 0 THEN NULL ELSE num_indiv END AS num_indiv FROM ni WHERE _split = 'train'),
z AS (SELECT *, (num_indiv - avg(num_indiv) OVER ()) / nullif(stddev_samp(num_indiv) OVER (), 0) AS s,
  CAST(num_indiv - min(num_indiv) OVER () AS DOUBLE) / nullif(max(num_indiv) OVER () - min(num_indiv) OVER (), 0) AS r,
  CASE WHEN seg IS NOT NULL THEN dense_rank() OVER (PARTITION BY seg IS NULL ORDER BY seg) - 1 END AS code FROM t)
"""


def _e15_rows(spark, sf):
    return _train(ni(spark, sf)).select(
        "id", F.when(F.col("id") % 4 != 0, F.col("c_mktsegment")).alias("seg"), "_split",
        F.when(F.col("id") % 5 != 0, F.col("num_indiv")).alias("num_indiv"))


@query("e15_default_label_encoder", _E15 + """SELECT id, _split, CAST(coalesce(code, 0) AS INTEGER) AS seg,
  coalesce(s, 0) AS num_indiv FROM z""", round_cols=["num_indiv"])
def e15_default(spark, sf):
    """E15 with its defaults: standardise, label codes, gaps filled with 0."""
    return encode.preprocess(_e15_rows(spark, sf))


@query("e15_min_max", _E15 + """SELECT id, _split, CAST(coalesce(code, 0) AS INTEGER) AS seg,
  coalesce(r, 0) AS num_indiv FROM z""", round_cols=["num_indiv"])
def e15_min_max(spark, sf):
    """E15 with min-max scaling."""
    return encode.preprocess(_e15_rows(spark, sf), normalize_num="min_max")


@query("e15_fill_mean", _E15 + """SELECT id, _split, coalesce(CAST(code AS DOUBLE), avg(code) OVER ()) AS seg,
  coalesce(s, avg(s) OVER ()) AS num_indiv FROM z""", round_cols=["seg", "num_indiv"])
def e15_fill_mean(spark, sf):
    """E15 with gaps filled by the column mean."""
    return encode.preprocess(_e15_rows(spark, sf), fillmean="mean")


@query("e15_fill_median", _E15 + """SELECT id, _split,
  coalesce(CAST(code AS DOUBLE), (SELECT quantile_cont(code, 0.5) FROM z)) AS seg,
  coalesce(s, (SELECT quantile_cont(s, 0.5) FROM z)) AS num_indiv FROM z""", round_cols=["seg", "num_indiv"])
def e15_fill_median(spark, sf):
    """E15 with gaps filled by the column median."""
    return encode.preprocess(_e15_rows(spark, sf), fillmean="median")


@query("e3_label_encode_names", "SELECT c_custkey AS id, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS name "
       "FROM customer")
def e3_names(spark, sf):
    """E3 on a column with a value for nearly every row: codes joined, no limit."""
    c = tables.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return encode.label_encode(c, ["name"])


@query("e4_one_hot_long", """SELECT c_custkey AS id, 'name' AS "column",
  CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code FROM customer
UNION ALL SELECT c_custkey, 'segment', CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) FROM customer""")
def e4_long(spark, sf):
    """E4 in long form on a wide and a narrow category."""
    c = tables.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return encode.one_hot_long(c, ["name", "segment"])


def _name_rows(spark, sf):
    h = hh(spark, sf).select("id", "_split", "c_nationkey")
    c = tables.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                        F.col("c_mktsegment").alias("segment"))
    return h.join(c, "id")


def _places(rows, size):
    return rows.select("id", F.concat_ws(" ", F.col("places").cast("array<string>")).alias("places"), F.lit(size).cast("long").alias("size"))


_NAME_PLACES = f"""WITH {HH},
r AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer),
p AS (SELECT id, dense_rank() OVER (ORDER BY name) - 1 AS n, dense_rank() OVER (ORDER BY segment) - 1 AS s,
  dense_rank() OVER (ORDER BY nation) - 1 AS k FROM r),
z AS (SELECT max(n) + 1 AS nn, max(s) + 1 AS ns, max(k) + 1 AS nk FROM p)
"""


@query("e5_joint_encode_names", _NAME_PLACES + """SELECT id, n || ' ' || (nn + s) AS places, CAST(nn + ns AS BIGINT) AS size
FROM p, z""")
def e5_names(spark, sf):
    """E5 without a limit: one vocabulary over train and test rows, a value for nearly every row among them."""
    d = _name_rows(spark, sf)
    both = schema.union_frames([d.where(F.col("_split") == s) for s in ("train", "test")])
    return _places(*encode.one_hot_places(both, ["name", "segment"]))


@query("e6_encode_all_but_names", _NAME_PLACES + """
SELECT id, k || ' ' || (nk + n) || ' ' || (nk + nn + s) AS places, CAST(nk + nn + ns AS BIGINT) AS size FROM p, z""")
def e6_names(spark, sf):
    """E6 without a limit: all columns but the keys, numbers included, in one sparse vector; its places."""
    d = encode.encode_all_but_sparse(_name_rows(spark, sf), [])
    text = F.col("categories").cast("string")  # (size,[places],[ones])
    return d.select("id", F.translate(F.regexp_extract(text, r"\[([^\]]*)\]", 1), ",", " ").alias("places"),
                    F.regexp_extract(text, r"\((\d+),", 1).cast("long").alias("size"))


@query("u5_columns_to_encode", f"WITH {HH} SELECT id, country, poor, c_nationkey FROM hh")
def u5(spark, sf):
    """The columns of one list that another lacks, by name and in order."""
    h = hh(spark, sf)
    return h.select(*schema.column_difference(h.columns, ["c_mktsegment", "_split"]))


@query("f2_estimator_hook", f"""WITH {HH} SELECT country, poor, c_mktsegment, count(*) AS n,
  count(*) / any_value(tot) * 100 AS pct, max(c_nationkey) AS value
FROM hh JOIN (SELECT country AS k, count(*) AS tot FROM hh GROUP BY 1) ON k = country
GROUP BY country, poor, c_mktsegment""", round_cols=["pct"])
def f2(spark, sf):
    """a caller's own aggregate per cell beside the share (the ``estimator`` hook)."""
    return profile.class_category_share(hh(spark, sf), "c_mktsegment", "poor", by=["country"],
                                        estimator=F.max("c_nationkey"))


@query("p13_preprocess_enforce", f"""WITH {HH},\n{IND},\n{NI},
t AS (SELECT id, c_mktsegment, c_nationkey, num_indiv, _split FROM ni WHERE _split = 'test')
SELECT id, _split,
  coalesce((c_nationkey - avg(c_nationkey) OVER ()) / nullif(stddev_samp(c_nationkey) OVER (), 0), 0) AS c_nationkey,
  coalesce((num_indiv - avg(num_indiv) OVER ()) / nullif(stddev_samp(num_indiv) OVER (), 0), 0) AS num_indiv,
  {_dummies('c_mktsegment', SEGMENTS)}, CAST(0 AS INTEGER) AS not_in_validation
FROM t""", round_cols=["c_nationkey", "num_indiv"])
def p13(spark, sf):
    """P13/E15 on validation rows: train's vocabulary, then train's column list
    enforced (a train-only column is added as 0), own scaling statistics."""
    sel = ni(spark, sf).select("id", "c_mktsegment", "c_nationkey", "num_indiv", "_split")
    tr, te = _train(sel), sel.where(F.col("_split") == "test")
    cols = encode.preprocess(tr, categorical="get_dummies").columns + ["not_in_validation"]
    return encode.preprocess(te, categorical="get_dummies", vocab_from=tr, enforce=cols)


# ------------------------------------------------------------------ the same operators on labelled documents

def _docs(spark, sf):
    return tables.labelled_documents(spark, sf)


@query("a4_median_doc_length", f"""WITH {DOCS}
SELECT lang AS "column", avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median FROM docs GROUP BY lang""",
       round_cols=["mean", "median"])
def a4_docs(spark, sf):
    """A4 on documents: mean and exact median length per language (long-tailed values)."""
    d = _docs(spark, sf).select(F.col("lang").alias("column"), F.col("n_chars").cast("double").alias("value"))
    med = profile.exact_quantile(d, "value", 0.5, by=["column"], out_col="median")
    return d.groupBy("column").agg(F.avg("value").alias("mean")).join(med, "column")


@query("a11_doc_target_ratio", f"""WITH {DOCS}
SELECT lang, avg(CAST(poor AS INTEGER)) * 100 AS pct_positive FROM docs WHERE _split = 'train' GROUP BY lang""",
       round_cols=["pct_positive"])
def a11_docs(spark, sf):
    """A11 on labelled documents: percent toxic per language."""
    return profile.target_ratio(_train(_docs(spark, sf)), by=["lang"])


@query("v7_doc_length_auc", f"""WITH {DOCS},
d AS (SELECT n_chars, sum(CAST(poor AS INTEGER)) AS pos, sum(1 - CAST(poor AS INTEGER)) AS neg
      FROM docs WHERE _split = 'train' GROUP BY n_chars),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM d)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM c""", round_cols=["auc"])
def v7_docs(spark, sf):
    """V7 on documents: ROC AUC of document length as a toxicity score."""
    return metrics.roc_auc(_train(_docs(spark, sf)), "poor", "n_chars")


@query("e13_doc_source_target_encode", f"""WITH {DOCS},
pr AS (SELECT avg(CAST(poor AS DOUBLE)) AS prior FROM docs WHERE _split = 'train'),
st AS (SELECT source, count(*) AS n, avg(CAST(poor AS DOUBLE)) AS m FROM docs WHERE _split = 'train' GROUP BY 1),
enc AS (SELECT source, prior * (1 - 1 / (1 + exp(-(n - 10) / 5.0))) + m * (1 / (1 + exp(-(n - 10) / 5.0))) AS e
        FROM st, pr)
SELECT docs.id, docs._split, coalesce(enc.e, pr.prior) AS source_te
FROM docs LEFT JOIN enc ON docs.source = enc.source, pr""", round_cols=["source_te"])
def e13_docs(spark, sf):
    """E13 on documents: smoothed toxicity encoding of the source, fitted on labelled rows."""
    d = _docs(spark, sf).select("id", "_split", "source", "poor")
    out = encode.smoothed_target_encode(d, "source", min_samples_leaf=10, smoothing=5,
                                        fit_on=F.col("_split") == "train", out="source_te")
    return out.select("id", "_split", "source_te")
