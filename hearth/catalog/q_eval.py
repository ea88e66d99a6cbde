"""Catalog: sampling and splitting (R1-R5, J2 per fold), evaluation metrics
(V1-V9), fold/country averages (A17-A19), score post-processing (P14-P17),
mean ensemble (M15) and the metrics sink (S6)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearth.catalog.common import hh, scored
from hearth.catalog.registry import query
from hearth.catalog.sqlfrag import BASE, HH, hexint, md5_key
from hearth.functions.exprs import logistic
from hearth.operators import metrics, sampling, schema
from hearth.sources import io


def _train(df):
    return df.where(F.col("_split") == "train")


def _th(spark, sf):
    return _train(hh(spark, sf))


T = f"WITH {HH},\nt AS (SELECT * FROM hh WHERE _split = 'train')\n"

# ------------------------------------------------------------------ sampling


@query("r1_downsample", T + f""",
maj AS (SELECT *, row_number() OVER (ORDER BY {md5_key(['id'], 144)}, id) AS r FROM t WHERE NOT poor)
SELECT * EXCLUDE (r) FROM maj WHERE r <= (SELECT count(*) FROM t WHERE poor)
UNION ALL
SELECT * FROM t WHERE poor""")
def r1(spark, sf):
    """Downsample the majority class to the minority's size (seed 144)."""
    return sampling.downsample(_th(spark, sf), "poor", seed=144)


@query("r2_upsample", T + f""",
mino AS (SELECT *, row_number() OVER (ORDER BY {md5_key(['id'], 144)}, id) AS r FROM t WHERE poor),
cnt AS (SELECT count(*) FILTER (WHERE poor) AS nmin, count(*) FILTER (WHERE NOT poor) AS nmaj FROM t),
draws AS (SELECT i AS _draw, {hexint(md5_key(['i'], 144), 15)} % nmin + 1 AS r
          FROM (SELECT unnest(range(nmaj)) AS i, nmin FROM cnt))
SELECT *, CAST(NULL AS BIGINT) AS _draw FROM t WHERE NOT poor
UNION ALL
SELECT mino.* EXCLUDE (r), draws._draw FROM draws JOIN mino ON draws.r = mino.r""")
def r2(spark, sf):
    """R2: upsample the minority class with replacement to the majority's size."""
    return sampling.upsample(_th(spark, sf), "poor", seed=144)


@query("r3_stratified_kfold", T + f"""
SELECT *, CAST((row_number() OVER (PARTITION BY country, poor ORDER BY {md5_key(['id'], 2)}, id) - 1) % 3
               AS INTEGER) AS fold
FROM t""")
def r3(spark, sf):
    """Shuffled stratified 3-fold assignment per country (seed 2)."""
    return sampling.stratified_kfold(_th(spark, sf), k=3, seed=2, by=["country"])


@query("r4_kfold_ordered", T + """
SELECT *, CAST(ntile(3) OVER (PARTITION BY country, poor ORDER BY id) - 1 AS INTEGER) AS fold FROM t""")
def r4(spark, sf):
    """Unshuffled stratified folds: contiguous blocks per class in key order."""
    return sampling.stratified_kfold_ordered(_th(spark, sf), k=3, by=["country"])


@query("r5_holdout", T + f"""
SELECT * EXCLUDE (r, nt), CASE WHEN r <= nt THEN 'test' ELSE 'train' END AS _holdout FROM (
  SELECT *, row_number() OVER (PARTITION BY country, poor ORDER BY {md5_key(['id'], 7)}, id) AS r,
         ceil(count(*) OVER (PARTITION BY country, poor) * 0.05) AS nt FROM t)""")
def r5(spark, sf):
    """95/5 stratified holdout per country (seed 7)."""
    return sampling.stratified_holdout(_th(spark, sf), test_size=0.05, seed=7, by=["country"])


# ------------------------------------------------------------------ metrics over a deterministic score

S = BASE + ", t AS (SELECT * FROM sc WHERE _split = 'train')\n"


def _scored_train(spark, sf):
    return _train(scored(spark, sf))


_CC = """count(*) FILTER (WHERE poor AND p > 0.5) AS tp, count(*) FILTER (WHERE NOT poor AND p > 0.5) AS fp,
  count(*) FILTER (WHERE poor AND NOT p > 0.5) AS fn, count(*) FILTER (WHERE NOT poor AND NOT p > 0.5) AS tn"""
_LL = "avg(-(CAST(poor AS DOUBLE) * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + " \
      "(1 - CAST(poor AS DOUBLE)) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))))"


def _r(num, den):
    return f"coalesce(CAST({num} AS DOUBLE) / nullif({den}, 0), 0.0)"


@query("v1_log_loss", S + f"SELECT country, {_LL} AS log_loss FROM t GROUP BY country", round_cols=["log_loss"])
def v1(spark, sf):
    """V1: clipped log loss per country."""
    return metrics.log_loss(_scored_train(spark, sf), "poor", "p", by=["country"])


_REPORT_SQL = S + f"""SELECT country, n, log_loss, tp, fp, fn, tn,
  {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall,
  ({_r('tp', 'tp + fn')} + {_r('tn', 'tn + fp')}) / 2 AS balanced_auc
FROM (SELECT country, count(*) AS n, {_LL} AS log_loss, {_CC} FROM t GROUP BY country)"""


@query("v2_v6_classification_report", _REPORT_SQL,
       round_cols=["log_loss", "f1", "precision", "recall", "balanced_auc"])
def v_report(spark, sf):
    """V1-V6: log loss, confusion counts, F1, precision, recall, balanced AUC."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"])


@query("v2_v6_report_rollup", S + f"""SELECT country, n, log_loss, tp, fp, fn, tn,
  {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall,
  ({_r('tp', 'tp + fn')} + {_r('tn', 'tn + fp')}) / 2 AS balanced_auc
FROM (SELECT country, count(*) AS n, {_LL} AS log_loss, {_CC} FROM t GROUP BY ROLLUP (country))""",
       round_cols=["log_loss", "f1", "precision", "recall", "balanced_auc"])
def v_rollup(spark, sf):
    """V1-V6 per country and over all countries (rollup subtotal, country NULL)."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"], rollup=True)


@query("v2_f1", S + f"SELECT country, {_r('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT country, {_CC} "
       "FROM t GROUP BY country)", round_cols=["f1"])
def v2(spark, sf):
    """V2: F1 of the hard label p > 0.5."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"]).select(
        "country", "f1")


@query("v3_recall", S + f"SELECT country, {_r('tp', 'tp + fn')} AS recall FROM (SELECT country, {_CC} "
       "FROM t GROUP BY country)", round_cols=["recall"])
def v3(spark, sf):
    """V3: recall of the hard label."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"]).select(
        "country", "recall")


@query("v4_precision", S + f"SELECT country, {_r('tp', 'tp + fp')} AS precision FROM (SELECT country, {_CC} "
       "FROM t GROUP BY country)", round_cols=["precision"])
def v4(spark, sf):
    """V4: precision of the hard label (0 when nothing is predicted positive)."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"]).select(
        "country", "precision")


@query("v5_confusion_matrix", S + f"""SELECT country, v.truth, v.predicted, v.n FROM
  (SELECT country, {_CC} FROM t GROUP BY country) c,
  LATERAL (VALUES (0, 0, c.tn), (0, 1, c.fp), (1, 0, c.fn), (1, 1, c.tp)) AS v(truth, predicted, n)""")
def v5(spark, sf):
    """V5: full 2x2 confusion matrix per country (zero cells included)."""
    return metrics.confusion_matrix(_scored_train(spark, sf), "poor", metrics.hard_label("p"), by=["country"])


@query("v6_balanced_auc", S + f"SELECT country, ({_r('tp', 'tp + fn')} + {_r('tn', 'tn + fp')}) / 2 AS "
       f"balanced_auc FROM (SELECT country, {_CC} FROM t GROUP BY country)", round_cols=["balanced_auc"])
def v6(spark, sf):
    """V6: ``roc_auc_score`` on hard labels, (TPR + TNR) / 2."""
    return metrics.classification_report(_scored_train(spark, sf), "poor", "p", by=["country"]).select(
        "country", "balanced_auc")


_AUC_SQL = S + """, d AS (SELECT country, p, sum(CAST(poor AS INTEGER)) AS pos, sum(1 - CAST(poor AS INTEGER)) AS neg
             FROM t GROUP BY country, p),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY country ORDER BY p
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d)
SELECT country, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY country"""


@query("v7_roc_auc", _AUC_SQL, round_cols=["auc"])
def v7(spark, sf):
    """V7: exact tie-safe ROC AUC of scores per country."""
    return metrics.roc_auc(_scored_train(spark, sf), "poor", "p", by=["country"])


_CURVE_SQL = S + """, d AS (SELECT country, p, sum(CAST(poor AS INTEGER)) AS pos, sum(1 - CAST(poor AS INTEGER)) AS neg
             FROM t GROUP BY country, p),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb,
             sum(pos) OVER (PARTITION BY country) AS tot_pos, sum(neg) OVER (PARTITION BY country) AS tot_neg FROM d
      WINDOW w AS (PARTITION BY country ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT country, p AS threshold, (tot_pos - pb) / tot_pos AS tpr, (tot_neg - nb) / tot_neg AS fpr,
       (tot_pos - pb) / nullif((tot_pos - pb) + (tot_neg - nb), 0) AS precision FROM c"""


@query("v7_roc_curve", _CURVE_SQL, round_cols=["threshold", "tpr", "fpr", "precision"])
def v7_curve(spark, sf):
    """V7: ROC / PR curve points per distinct score threshold."""
    return metrics.roc_curve(_scored_train(spark, sf), "poor", "p", by=["country"])


@query("v8_confusion_table", S + f"""SELECT country, v.* FROM (SELECT country, {_CC} FROM t GROUP BY country) c,
  LATERAL (VALUES ('not poor', c.tn, c.fp), ('poor', c.fn, c.tp)) AS v(truth, "not poor", poor)""")
def v8(spark, sf):
    """V8: confusion matrix labelled with class names (the printout's table)."""
    return metrics.confusion_table(_scored_train(spark, sf), "poor", metrics.hard_label("p"),
                                   class_names=("not poor", "poor"), by=["country"])


@query("v9_penalty_rows", S + """SELECT id, country, poor, p,
  -(CAST(poor AS DOUBLE) * ln(greatest(least(p, 1 - 1e-15), 1e-15)) +
    (1 - CAST(poor AS DOUBLE)) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))) AS penalty FROM t""",
       round_cols=["p", "penalty"])
def v9(spark, sf):
    """V9: per-row log-loss penalty (0.4 -> 0.92 and 0.1 -> 2.30 for a true 1)."""
    return metrics.penalty_rows(_scored_train(spark, sf).select("id", "country", "poor", "p"), "poor", "p")


# ------------------------------------------------------------------ fold and country averages

_FOLDS = BASE + f""", t AS (SELECT *, (row_number() OVER (PARTITION BY country, poor ORDER BY {md5_key(['id'], 2)}, id)
                    - 1) % 3 AS fold FROM sc WHERE _split = 'train'),
f AS (SELECT country, fold, {_LL} AS log_loss, {_CC} FROM t GROUP BY country, fold),
m AS (SELECT country, fold, 'log_loss' AS metric, log_loss AS value FROM f
      UNION ALL SELECT country, fold, 'f1', {_r('2 * tp', '2 * tp + fp + fn')} FROM f
      UNION ALL SELECT country, fold, 'recall', {_r('tp', 'tp + fn')} FROM f)
"""


def _fold_metrics(spark, sf):
    t = sampling.stratified_kfold(_scored_train(spark, sf), k=3, seed=2, by=["country"])
    rep = metrics.classification_report(t, "poor", "p", by=["country", "fold"])
    return metrics.long_metrics(rep, ["country", "fold"], ["log_loss", "f1", "recall"])


@query("a17_mean_over_folds", _FOLDS + "SELECT country, metric, avg(value) AS mean_value, count(*) AS n_folds "
       "FROM m GROUP BY country, metric", round_cols=["mean_value"])
def a17(spark, sf):
    """Per-fold metrics (3 stratified folds per country), averaged."""
    return metrics.mean_over_folds(_fold_metrics(spark, sf))


@query("a18_weighted_log_loss", _FOLDS + """, cm AS (SELECT country, avg(value) AS log_loss FROM m
  WHERE metric = 'log_loss' GROUP BY country)
SELECT sum(CASE country WHEN 'A' THEN 4041 WHEN 'B' THEN 1604 ELSE 3187 END * log_loss)
       / sum(CASE country WHEN 'A' THEN 4041 WHEN 'B' THEN 1604 ELSE 3187 END) AS weighted_log_loss FROM cm""",
       round_cols=["weighted_log_loss"])
def a18(spark, sf):
    """A18 ``mean_log_loss``: fold means weighted by the countries' test sizes."""
    fm = metrics.mean_over_folds(_fold_metrics(spark, sf)).where(F.col("metric") == "log_loss")
    return metrics.weighted_country_mean(fm.withColumnRenamed("mean_value", "log_loss"))


@query("a19_competition_metric", _FOLDS + """SELECT avg(log_loss) AS mean_log_loss FROM
  (SELECT country, avg(value) AS log_loss FROM m WHERE metric = 'log_loss' GROUP BY country)""",
       round_cols=["mean_log_loss"])
def a19(spark, sf):
    """Unweighted mean over countries of the mean fold log loss."""
    fm = metrics.mean_over_folds(_fold_metrics(spark, sf)).where(F.col("metric") == "log_loss")
    return metrics.unweighted_country_mean(fm.withColumnRenamed("mean_value", "log_loss"))


@query("s6_metrics_json", _FOLDS + "SELECT country, CAST(fold AS BIGINT) AS fold, metric, value FROM m",
       round_cols=["value"])
def s6(spark, sf):
    """Per-fold metrics frame written as JSON to the shared folder and read back."""
    return io.metrics_roundtrip(spark, _fold_metrics(spark, sf).withColumn("fold", F.col("fold").cast("long")))


# ------------------------------------------------------------------ score post-processing


@query("p14_probability_component", S + "SELECT id, p FROM t", round_cols=["p"])
def p14(spark, sf):
    """P(poor) taken out of a two-class probability vector."""
    t = _scored_train(spark, sf).select("id", array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias("probability"))
    return metrics.probability_component(t, "probability", 1, out="p").select("id", "p")


@query("p15_threshold", S + "SELECT id, p > 0.5 AS pred FROM t")
def p15(spark, sf):
    """Hard label, strict p > 0.5."""
    return _scored_train(spark, sf).select("id", metrics.hard_label("p").alias("pred"))


@query("p16_post_rules", S + """SELECT id, CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END AS hard,
  CASE WHEN p > 0.9 THEN 1.0 WHEN p < 0.05 THEN 0.0 ELSE p END AS snap, 0.0 AS zero FROM t""",
       round_cols=["hard", "snap", "zero"])
def p16(spark, sf):
    """The experiment log's post-rules on probabilities."""
    return _scored_train(spark, sf).select("id", metrics.post_rule("p", "hard").alias("hard"),
                                           metrics.post_rule("p", "snap").alias("snap"),
                                           metrics.post_rule("p", "zero").alias("zero"))


@query("p17_country_submission", BASE + "SELECT id, country, p AS poor FROM sc WHERE _split = 'test'",
       round_cols=["poor"])
def p17(spark, sf):
    """P17 + U2: one submission frame per country, concatenated."""
    s = scored(spark, sf).where(F.col("_split") == "test")
    subs = [metrics.country_submission(s.where(F.col("country") == c), c) for c in ("A", "B", "C")]
    return schema.union_frames(subs)


@query("m15_mean_ensemble", S + """SELECT id, (p + 1.0 / (1.0 + exp(-(c_nationkey - 12) / 5.0))) / 2 AS p,
  CAST(2 AS BIGINT) AS n_models FROM t""", round_cols=["p"])
def m15(spark, sf):
    """Mean of two models' probabilities per household."""
    t = _scored_train(spark, sf)
    other = t.select("id", logistic((F.col("c_nationkey") - 12) / F.lit(5.0)).alias("p"))
    return metrics.mean_ensemble([t.select("id", "p"), other])
