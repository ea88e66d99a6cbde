"""Evaluation metrics and score post-processing.

Every metric is an aggregate over ``(label, score)`` rows grouped by
``by`` (country, fold, ...), so per-fold and per-country metrics come out of
one pass with map-side partial aggregation. Undefined ratios are 0, as in
the reference's metric library defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import LOG_LOSS_EPS, log_loss_term, prob_of_class
from hearth.operators.ranking import ordered_cumulative

# Fixed values from the reference: test-set sizes per country used as the
# weights of the mean log loss (A 4041, B 1604, C 3187; 8832 in all).
COUNTRY_TEST_ROWS = {"A": 4041, "B": 1604, "C": 3187}


def _y(label: str) -> Column:
    return F.col(label).cast("int")


def hard_label(p: str | Column, threshold: float = 0.5) -> Column:
    """Strict ``p > threshold``."""
    pc = F.col(p) if isinstance(p, str) else p
    return pc > F.lit(threshold)


def post_rule(p: str | Column, rule: str, hi: float = 0.9, lo: float = 0.05) -> Column:
    """Probability post-rules tried in the reference's experiment log.
    ``hard``: 1/0 at 0.5; ``snap``: >hi -> 1, <lo -> 0; ``zero``: constant 0."""
    pc = F.col(p) if isinstance(p, str) else p
    if rule == "hard":
        return F.when(pc > 0.5, 1.0).otherwise(0.0)
    if rule == "snap":
        return F.when(pc > hi, 1.0).when(pc < lo, 0.0).otherwise(pc)
    if rule == "zero":
        return F.lit(0.0)
    raise ValueError(f"unknown rule {rule!r}")


def probability_component(df: DataFrame, vec_col: str = "probability", index: int = 1,
                          out: str = "p") -> DataFrame:
    """``preds[:, index]`` from an ML probability vector."""
    return df.withColumn(out, prob_of_class(vec_col, index))


def country_submission(df: DataFrame, country: str | Column | None = None, score: str = "p",
                       key: str = "id") -> DataFrame:
    """P17 ``make_country_sub``: ``(id, country, poor=P(poor))``."""
    c = F.col("country") if country is None else (F.lit(country) if isinstance(country, str) else country)
    return df.select(F.col(key).alias("id"), c.alias("country"), F.col(score).cast("double").alias("poor"))


def log_loss(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
             eps: float = LOG_LOSS_EPS) -> DataFrame:
    """V1: mean binary cross entropy with clipping."""
    return df.groupBy(*by).agg(F.avg(log_loss_term(label, score, eps)).alias("log_loss"))


def confusion_counts(df: DataFrame, label: str, pred: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one aggregate."""
    y = _y(label)
    yh = (F.col(pred) if isinstance(pred, str) else pred).cast("int")

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return df.groupBy(*by).agg(cnt((y == 1) & (yh == 1)).alias("tp"), cnt((y == 0) & (yh == 1)).alias("fp"),
                               cnt((y == 1) & (yh == 0)).alias("fn"), cnt((y == 0) & (yh == 0)).alias("tn"))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_expr() -> Column:
    return _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def recall_expr() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def precision_expr() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def balanced_auc_expr() -> Column:
    """V6: ROC AUC of hard labels = (TPR + TNR) / 2 (ledger D11)."""
    return (_ratio(F.col("tp"), F.col("tp") + F.col("fn")) + _ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2


def classification_report(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
                          threshold: float = 0.5, eps: float = LOG_LOSS_EPS, rollup: bool = False) -> DataFrame:
    """V1-V6 together: n, log loss, confusion counts, f1, precision, recall,
    balanced AUC for the hard label ``score > threshold``. ``rollup=True``
    adds the subtotal rows (e.g. all countries together, ``country`` NULL)
    from the same single aggregation."""
    y = _y(label)
    yh = hard_label(score, threshold).cast("int")

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    agg = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(log_loss_term(label, score, eps)).alias("log_loss"),
        cnt((y == 1) & (yh == 1)).alias("tp"), cnt((y == 0) & (yh == 1)).alias("fp"),
        cnt((y == 1) & (yh == 0)).alias("fn"), cnt((y == 0) & (yh == 0)).alias("tn"))
    return agg.select("*", f1_expr().alias("f1"), precision_expr().alias("precision"),
                      recall_expr().alias("recall"), balanced_auc_expr().alias("balanced_auc"))


def confusion_matrix(df: DataFrame, label: str, pred: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """V5: the full 2x2 grid (truth, predicted, n), zero cells included."""
    cc = confusion_counts(df, label, pred, by)
    return cc.selectExpr(*by, "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (truth, predicted, n)")


def confusion_table(df: DataFrame, label: str, pred: str | Column, class_names: Sequence[str] = ("False", "True"),
                    by: Sequence[str] = ()) -> DataFrame:
    """V8: rows = true class name, one column per predicted class name."""
    cc = confusion_counts(df, label, pred, by)
    rows = F.array(*[F.struct(F.lit(name).alias("truth"), F.col(no).alias("no"), F.col(yes).alias("yes"))
                     for name, no, yes in zip(class_names, ("tn", "fn"), ("fp", "tp"))])
    out = cc.select(*by, F.inline(rows))
    return out.toDF(*by, "truth", *class_names)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """V7: exact, tie-safe ROC AUC of scores (rank-sum / Mann-Whitney form):
    ``sum_v pos(v) * (neg(<v) + neg(v)/2) / (P * N)``, from the distributed
    running count of negatives over the distinct scores."""
    y = _y(label)
    cum = ordered_cumulative(df.where(F.col(label).isNotNull()), score,
                             {"pos": y.cast("long"), "neg": (1 - y).cast("long")}, by=by)
    agg = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("__s"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*by, "n_pos", "n_neg",
                      F.try_divide(F.col("__s"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """V7 curve: for each distinct score threshold t (predict positive when
    score >= t), the true and false positive rates, plus precision."""
    y = _y(label)
    cum = ordered_cumulative(df.where(F.col(label).isNotNull()), score,
                             {"pos": y.cast("long"), "neg": (1 - y).cast("long")}, by=by)
    tp = F.col("tot_pos") - F.col("pos_before")
    fp = F.col("tot_neg") - F.col("neg_before")
    return cum.select(*by, F.col(score).alias("threshold"),
                      F.try_divide(tp.cast("double"), F.col("tot_pos")).alias("tpr"),
                      F.try_divide(fp.cast("double"), F.col("tot_neg")).alias("fpr"),
                      F.try_divide(tp.cast("double"), (tp + fp)).alias("precision"))


def penalty_rows(df: DataFrame, label: str, score: str, eps: float = LOG_LOSS_EPS) -> DataFrame:
    """V9: the per-row log-loss term."""
    return df.withColumn("penalty", log_loss_term(label, score, eps))


def long_metrics(report: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Reshape a wide report into ``(by..., metric, value)`` rows (S6 layout)."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), report[m].cast("double").alias("value")) for m in metrics])
    return report.select(*by, F.inline(rows))


def mean_over_folds(metrics: DataFrame, by: Sequence[str] = ("country", "metric")) -> DataFrame:
    """``np.average`` of the per-fold values."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_folds"))


def weighted_country_mean(per_country: DataFrame, value: str = "log_loss",
                          weights: Mapping[str, float] = COUNTRY_TEST_ROWS) -> DataFrame:
    """A18 ``mean_log_loss``: country values weighted by test-set size."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    ww = F.element_at(w, F.col("country"))
    return per_country.agg(F.try_divide(F.sum(ww * F.col(value)), F.sum(F.when(F.col(value).isNotNull(), ww)))
                           .alias(f"weighted_{value}"))


def unweighted_country_mean(per_country: DataFrame, value: str = "log_loss") -> DataFrame:
    """The competition metric, plain mean over countries (ledger D14)."""
    return per_country.agg(F.avg(value).alias(f"mean_{value}"))


def mean_ensemble(scores: Sequence[DataFrame], key: str = "id", score: str = "p",
                  by: Sequence[str] = ()) -> DataFrame:
    """Average of several models' probabilities per row key."""
    u = scores[0].select(*by, key, score)
    for s in scores[1:]:
        u = u.unionByName(s.select(*by, key, score))
    return u.groupBy(*by, key).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("n_models"))
