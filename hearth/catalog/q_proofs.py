"""Catalog: the training drivers (M4, M8-M13, M16; F1, F3) with results that SQL can recompute.

``CategoryRate`` is fitted by one aggregate, so folds, resampling, fit, scores and
metrics of a whole driver follow in SQL; fitted logistic models are held
against the gradient of their loss, whose row counts and verdict SQL knows.
R6 (SMOTE) stands here too, with its neighbours by brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.catalog.common import hh, ind, ni
from hearth.catalog.q_eval import _CC, _LL, _r
from hearth.catalog.q_models import _cv_c_recipe
from hearth.catalog.registry import query
from hearth.catalog.sqlfrag import HH, IND, NI, hexint, md5_key
from hearth.operators import encode, sampling, schema
from hearth.plans import certify, cv, experiments, train
from hearth.plans.features import build_features
from hearth.plans.rates import CategoryRate
from hearth.plans.recipes import Recipe, standin_recipes

WEIGHT = 10.0
GRID = [1.0, 10.0, 100.0]


def _rate_recipes() -> dict[str, Recipe]:
    """The stand-in recipes with the nation key left as a category, and the rate model."""
    out = standin_recipes()
    for r in out.values():
        r.sparse, r.model = True, CategoryRate("c_nationkey", weight=WEIGHT)
    return out


def _rate(ones: str, rows: str, prior: str, weight: float | str = WEIGHT) -> str:
    return f"((coalesce({ones}, 0) + {weight!s} * {prior}) / (coalesce({rows}, 0) + {weight!s}))"


T = f"WITH {HH},\nt AS (SELECT * FROM hh WHERE _split = 'train')"
_FOLDS = f"""{T},
fd AS (SELECT *, (row_number() OVER (PARTITION BY country, poor ORDER BY {md5_key(['id'], 2)}, id) - 1) % 3 AS fold FROM t),
part AS (SELECT f AS fold, country, c_nationkey, sum(CAST(poor AS INT)) AS ones, count(*) AS n
  FROM fd, (VALUES (0), (1), (2)) AS v(f) WHERE fd.fold <> f GROUP BY ALL),
prior AS (SELECT fold, country, CAST(sum(ones) AS DOUBLE) / sum(n) AS prior FROM part GROUP BY ALL)"""
_VALUES = [("log_loss", "log_loss"), ("f1", _r("2 * tp", "2 * tp + fp + fn")), ("precision", _r("tp", "tp + fp")),
           ("recall", _r("tp", "tp + fn")), ("balanced_auc", f"({_r('tp', 'tp + fn')} + {_r('tn', 'tn + fp')}) / 2")]


@query("m12_category_rates", f"""{T},
r AS (SELECT country, c_nationkey, sum(CAST(poor AS INT)) AS ones, count(*) AS n FROM t GROUP BY ALL),
prior AS (SELECT country, CAST(sum(ones) AS DOUBLE) / sum(n) AS prior FROM r GROUP BY country)
SELECT id, country, {_rate('ones', 'n', 'prior')} AS poor
FROM hh JOIN prior USING (country) LEFT JOIN r USING (country, c_nationkey) WHERE _split = 'test'""", round_cols=["poor"])
def m12_rates(spark, sf):
    """A classifier brought along, fitted per country, all test rows scored."""
    return train.run_all(_rate_recipes(), hh(spark, sf), ind(spark, sf), parallel=True)


@query("m10_category_rate_cv", _FOLDS + f""",
s AS (SELECT fd.*, {_rate('ones', 'n', 'prior')} AS p FROM fd JOIN prior USING (fold, country)
  LEFT JOIN part USING (fold, country, c_nationkey)),
m AS (SELECT country, fold, {_LL} AS log_loss, {_CC} FROM s GROUP BY country, fold)
""" + "\nUNION ALL ".join(f"SELECT country, CAST(fold AS BIGINT) AS fold, '{name}' AS metric, {value} AS value FROM m"
                          for name, value in _VALUES), round_cols=["value"])
def m10_rates(spark, sf):
    """Stratified 3-fold cross-validation of every country, all metrics of every fold."""
    h, i = hh(spark, sf).where(F.col("_split") == "train"), ind(spark, sf)
    return schema.union_frames(train.parallel_map(lambda r: cv.cross_validate(r, h, i), _rate_recipes().values()))


@query("m10_category_rate_holdout", f"""{T},
o AS (SELECT *, row_number() OVER (PARTITION BY poor ORDER BY {md5_key(['id'], 0)}, id)
    <= ceil(count(*) OVER (PARTITION BY poor) * 0.05) AS out FROM t WHERE country = 'B'),
r AS (SELECT c_nationkey, sum(CAST(poor AS INT)) AS ones, count(*) AS n FROM o WHERE NOT out GROUP BY ALL),
prior AS (SELECT CAST(sum(ones) AS DOUBLE) / sum(n) AS prior FROM r),
s AS (SELECT o.*, {_rate('ones', 'n', 'prior')} AS p FROM o LEFT JOIN r USING (c_nationkey), prior WHERE out),
m AS (SELECT count(*) AS n, {_LL} AS log_loss, {_CC} FROM s)
SELECT n, log_loss, tp, fp, fn, tn, {", ".join(f"{v} AS {name}" for name, v in _VALUES[1:])}, 'B' AS country FROM m""",
       round_cols=["log_loss", "f1", "precision", "recall", "balanced_auc"])
def m10_rate_holdout(spark, sf):
    """M10, holdout form: 95/5 stratified split of country B, metrics of the held-out part."""
    return cv.holdout_validate(_rate_recipes()["B"], hh(spark, sf).where(F.col("_split") == "train"), ind(spark, sf), seed=0)


_BANDS = "CASE WHEN num_indiv < 8 THEN 'few' WHEN num_indiv < 12 THEN 'some' ELSE 'many' END"


@query("m11_category_rate_run_cv", f"""WITH {HH},\n{IND},\n{NI},
t AS (SELECT country, id, poor, {_BANDS} AS band, ntile(3) OVER (PARTITION BY country, poor ORDER BY id) - 1 AS fold
  FROM ni WHERE _split = 'train'),
part AS (SELECT f AS out, country, id, poor, band FROM t, (VALUES (0), (1), (2)) AS v(f) WHERE fold <> f),
size AS (SELECT out, country, count(*) FILTER (WHERE poor) AS nmin, count(*) FILTER (WHERE NOT poor) AS nmaj
  FROM part GROUP BY ALL),
mino AS (SELECT out, country, band, row_number() OVER (PARTITION BY out, country ORDER BY {md5_key(['id'], 144)}, id) AS r
  FROM part WHERE poor),
draw AS (SELECT out, country, {hexint(md5_key(['i'], 144), 15)} % nmin + 1 AS r
  FROM (SELECT out, country, nmin, unnest(range(nmaj)) AS i FROM size)),
up AS (SELECT out, country, band, 1 AS y FROM draw JOIN mino USING (out, country, r)
  UNION ALL SELECT out, country, band, 0 FROM part WHERE NOT poor),
r AS (SELECT out, country, band, sum(y) AS ones, count(*) AS n FROM up GROUP BY ALL),
prior AS (SELECT out, country, CAST(sum(ones) AS DOUBLE) / sum(n) AS prior FROM r GROUP BY ALL),
s AS (SELECT t.country, t.fold, t.poor, {_rate('ones', 'n', 'prior')} AS p
  FROM t JOIN prior ON prior.out = t.fold AND prior.country = t.country
  LEFT JOIN r ON r.out = t.fold AND r.country = t.country AND r.band = t.band)
SELECT CAST(fold AS BIGINT) AS fold, {_LL} AS log_loss, country FROM s GROUP BY fold, country""", round_cols=["log_loss"])
def m11_rates(spark, sf):
    """The generic harness with a user's feature function, upsampled train parts, label codes
    from the train part, and the user's classifier on them; log loss of every fold."""
    d = ni(spark, sf).where(F.col("_split") == "train").select("id", "country", "poor", "num_indiv")

    def bands(df):
        n = F.col("num_indiv")
        return df.withColumn("band", F.when(n < 8, "few").when(n < 12, "some").otherwise("many"))

    def one(c):
        rows = d.where(F.col("country") == c).drop("country")
        return cv.run_cv(rows, CategoryRate("band", weight=WEIGHT), func=bands, n_splits=3, how="up").withColumn("country", F.lit(c))

    return schema.union_frames(train.parallel_map(one, "ABC"))


@query("m13_category_rate_grid", _FOLDS + f""",
s AS (SELECT w, country, fold, avg(-(CASE WHEN poor THEN ln(p) ELSE ln(1 - p) END)) AS ll FROM (
  SELECT fd.*, w, {_rate('ones', 'n', 'prior', 'w')} AS p FROM fd JOIN prior USING (fold, country)
    LEFT JOIN part USING (fold, country, c_nationkey), (VALUES {", ".join(f"({w})" for w in GRID)}) AS g(w)) GROUP BY ALL),
m AS (SELECT country, w, avg(ll) AS log_loss FROM s GROUP BY ALL)
SELECT 'weight=' || CAST(CAST(w AS DOUBLE) AS VARCHAR) AS params, log_loss,
  log_loss = min(log_loss) OVER (PARTITION BY country) AS best, country FROM m""", round_cols=["log_loss"])
def m13_rates(spark, sf):
    """Grid search over a parameter of a classifier brought along, by the folds' mean log loss."""
    h, i = hh(spark, sf), ind(spark, sf)

    def one(r):
        found = experiments.grid_search(build_features(r, h, i), CategoryRate("c_nationkey"), {"weight": GRID})
        return found.withColumn("country", F.lit(r.country))

    return schema.union_frames(train.parallel_map(one, _rate_recipes().values()))


@query("m16_category_rate_adversarial", f"""WITH {HH},
o AS (SELECT country, c_nationkey, _split = 'test' AS y,
  row_number() OVER (PARTITION BY country, _split ORDER BY {md5_key(['id'], 0)}, id)
    <= ceil(count(*) OVER (PARTITION BY country, _split) * 0.25) AS out FROM hh),
r AS (SELECT country, c_nationkey, sum(CAST(y AS INT)) AS ones, count(*) AS n FROM o WHERE NOT out GROUP BY ALL),
prior AS (SELECT country, CAST(sum(ones) AS DOUBLE) / sum(n) AS prior FROM r GROUP BY country),
s AS (SELECT country, {_rate('ones', 'n', 'prior')} AS p, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg
  FROM o JOIN prior USING (country) LEFT JOIN r USING (country, c_nationkey) WHERE out GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY country ORDER BY p) - neg AS below FROM s)
SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)) AS auc, country FROM c GROUP BY country""",
       round_cols=["auc"])
def m16_rates(spark, sf):
    """A classifier brought along told to part train from test rows; held-out ROC AUC."""
    h, i = hh(spark, sf), ind(spark, sf)
    return schema.union_frames(train.parallel_map(lambda r: experiments.adversarial_validation(
        build_features(r, h, i), r.model).select("auc", F.lit(r.country).alias("country")),
        _rate_recipes().values()))


@query("m4_optimality", f"""{T},
c AS (SELECT *, (row_number() OVER (PARTITION BY poor ORDER BY {md5_key(['id'], 2)}, id) - 1) % 3 AS fold
  FROM t WHERE country = 'C')
SELECT 'C' AS country, CAST(f AS BIGINT) AS fold, count(*) AS n_rows, TRUE AS optimal
FROM c, (VALUES (0), (1), (2)) AS v(f) WHERE fold <> f GROUP BY f""")
def m4_optimal(spark, sf):
    """M4: the logistic fits of country C's folds are optimal (gradient of the penalised loss below 1e-3)."""
    return certify.cv_optimality(_cv_c_recipe(), hh(spark, sf).where(F.col("_split") == "train"), ind(spark, sf))


def _frames(spark, sf):
    return {c: build_features(r, hh(spark, sf), ind(spark, sf)) for c, r in standin_recipes().items()}


PENALTIES = [0.001, 0.01, 0.1]


@query("m13_optimality", f"""{T}
SELECT country, CAST(w AS DOUBLE) AS penalty, count(*) AS n_rows, TRUE AS optimal
FROM t, (VALUES {", ".join(f"({w})" for w in PENALTIES)}) AS g(w) GROUP BY country, w""", round_cols=["penalty"])
def m13_optimal(spark, sf):
    """The logistic fits on all train rows are optimal under every penalty of the grid."""
    return certify.penalty_optimality(_frames(spark, sf), PENALTIES)


@query("m16_optimality", f"""WITH {HH},
n AS (SELECT country, _split, count(*) AS n FROM hh GROUP BY ALL)
SELECT country, CAST(sum(n - ceil(n * 0.25)) AS BIGINT) AS n_rows, TRUE AS optimal FROM n GROUP BY country""")
def m16_optimal(spark, sf):
    """The logistic classifier of train against test rows is optimal."""
    return certify.adversarial_optimality(_frames(spark, sf), {"kind": "logistic", "C": 1.0})


_SMOTE = ["num_indiv", "c_nationkey", "c_mktsegment"]


@query("r6_smote", f"""WITH {HH},\n{IND},\n{NI},
code AS (SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS s
  FROM (SELECT DISTINCT c_mktsegment FROM hh)),
t AS (SELECT id, poor, CAST(num_indiv AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b, s AS c
  FROM ni JOIN code USING (c_mktsegment) WHERE _split = 'train'),
mino AS (SELECT *, row_number() OVER (ORDER BY {md5_key(['id'], 144)}, id) AS r FROM t WHERE poor),
near AS (SELECT x.id, y.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY
    (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c), y.id) AS at
  FROM mino x, mino y WHERE x.id <> y.id),
size AS (SELECT count(*) FILTER (WHERE poor) AS nmin, count(*) FILTER (WHERE NOT poor) AS nmaj FROM t),
draw AS (SELECT i AS _draw, {hexint(md5_key(['i'], '144'), 15)} % nmin + 1 AS r,
    {hexint(md5_key(['i'], '144neighbor'), 15)} % least(5, nmin - 1) + 1 AS at,
    {hexint(md5_key(['i'], '144gap'), 8)} / CAST(4294967296 AS DOUBLE) AS u
  FROM (SELECT unnest(range(nmaj - nmin)) AS i, nmin FROM size))
SELECT id, poor, a AS num_indiv, b AS c_nationkey, c AS c_mktsegment, CAST(NULL AS BIGINT) AS _draw FROM t
UNION ALL
SELECT x.id, TRUE, x.a + u * (y.a - x.a), x.b + u * (y.b - x.b), x.c + u * (y.c - x.c), _draw
FROM draw JOIN mino x USING (r) JOIN near ON near.id = x.id AND near.at = draw.at JOIN mino y ON y.id = near.other""",
       round_cols=_SMOTE)
def r6(spark, sf):
    """SMOTE on the train rows: exact 5 nearest minority rows, one synthetic row a draw."""
    coded = encode.label_encode(ni(spark, sf), ["c_mktsegment"]).where(F.col("_split") == "train")
    return sampling.smote(coded, _SMOTE, "poor", seed=144, k=5)
