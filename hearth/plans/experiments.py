"""Experiments named in the reference's notes.

* grid search: ``CrossValidator`` over a fold column (R3), so the folds are
  the same stratified, seeded folds as everywhere else;
* stacking: out-of-fold base-model scores, each row scored by its own fold's model -> meta model;
* adversarial validation: classify train vs test rows; AUC near 0.5 means
  the two come from the same distribution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators import metrics, sampling, schema
from hearth.plans.features import FeatureFrame
from hearth.plans.models import (assemble, dealt, fit_model, label_column, make_estimator, score, score_routed,
                                 sparse_encoder_stages)
from hearth.plans.recipes import FOLD_SEED, N_FOLDS
from hearth.plans.train import parallel_map
from hearth.session import checkpoint_root, written


def grid_search(ff: FeatureFrame, spec: dict | Estimator, grid: Mapping[str, Sequence], k: int = N_FOLDS,
                seed: int = FOLD_SEED, parallelism: int = 4) -> DataFrame:
    """Mean validation log loss of every parameter combination.

    ``grid`` maps ``pyspark.ml`` parameter names of the estimator (e.g.
    ``maxDepth``) to candidate values. Returns ``(params, log_loss, best)``.
    """
    spark = ff.df.sparkSession
    checkpoint_root(spark)
    train = label_column(ff.df.where(F.col("_split") == "train"))
    train = sampling.stratified_kfold(train, k=k, seed=seed)
    n = train.count()
    train = dealt(train, n, len(ff.feature_cols) + 8 * len(ff.cat_cols)).persist()
    est = spec if isinstance(spec, Estimator) else make_estimator(spec, n_rows=n)
    pgb = ParamGridBuilder()
    for name, values in grid.items():
        pgb = pgb.addGrid(est.getParam(name), list(values))
    maps = pgb.build()
    ev = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label",
                                           probabilityCol="probability")
    front = sparse_encoder_stages(ff.cat_cols, ff.feature_cols) if ff.cat_cols else [assemble(ff.feature_cols)]
    cv = CrossValidator(estimator=Pipeline(stages=[*front, est]), estimatorParamMaps=maps,
                        evaluator=ev, foldCol="fold", numFolds=k, parallelism=parallelism, seed=seed)
    try:
        fitted = cv.fit(train)
    finally:
        train.unpersist()
    rows = []
    best = min(range(len(maps)), key=lambda i: fitted.avgMetrics[i])
    for i, pm in enumerate(maps):
        desc = ", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
        rows.append((desc, float(fitted.avgMetrics[i]), i == best))
    return spark.createDataFrame(rows, "params string, log_loss double, best boolean")


def stack(ff: FeatureFrame, base_specs: Sequence[dict], meta_spec: dict | None = None, k: int = N_FOLDS,
          seed: int = FOLD_SEED) -> DataFrame:
    """M14 for one country: ``(id, p)`` of the test rows (see ``stack_all``)."""
    return stack_all({"": ff}, base_specs, meta_spec, k, seed).drop("country")


def stack_all(frames: Mapping[str, FeatureFrame], base_specs: Sequence[dict], meta_spec: dict | None = None,
              k: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """Stacking, for all countries side by side. Each base model is fitted once without
    each fold and once on all train rows; every fit of every country is one item of a
    single parallel run. Then each row is scored in one projection, train rows by
    the model that has not seen their fold, test rows by the full one; that written table
    trains and feeds the country's meta model. Returns ``(country, id, p)``."""
    meta_spec = meta_spec or {"kind": "logistic", "C": 1.0}
    names = [f"base_{i}" for i in range(len(base_specs))]

    def with_folds(ff: FeatureFrame) -> DataFrame:
        train = sampling.stratified_kfold(label_column(ff.df.where(F.col("_split") == "train")), k=k, seed=seed)
        test = label_column(ff.df.where(F.col("_split") == "test")).withColumn("fold", F.lit(None).cast("int"))
        return train.unionByName(test).persist()

    rows = {c: with_folds(ff) for c, ff in frames.items()}
    try:
        jobs = [(c, i, f) for i in range(len(base_specs)) for f in [*range(k), None] for c in frames]

        def fit_one(job):
            c, i, f = job
            seen = rows[c].where(F.col("fold").isNotNull() if f is None else F.col("fold") != f)
            return fit_model(seen, frames[c].feature_cols, base_specs[i], cat_cols=frames[c].cat_cols)

        fitted = dict(zip(jobs, parallel_map(fit_one, jobs)))

        def meta(c: str) -> DataFrame:
            d = rows[c]
            for i, name in enumerate(names):
                d = score_routed({f: fitted[c, i, f] for f in [*range(k), None]}, d, F.col("fold"), name)
            scored = written(d.select("id", "label", "fold", *names), "stacked")
            m = fit_model(scored.where(F.col("fold").isNotNull()), names, meta_spec)
            out = score(m, scored.where(F.col("fold").isNull()))
            return out.select(F.lit(c).alias("country"), "id", "p")

        return schema.union_frames(parallel_map(meta, frames))
    finally:
        for d in rows.values():
            d.unpersist()


def adversarial_validation(ff: FeatureFrame, spec: dict | Estimator, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """Can a model tell train rows from test rows? Returns the holdout
    ROC AUC of that classifier (0.5 = indistinguishable)."""
    d = ff.df.withColumn("is_test", F.col("_split") == "test").drop("poor")
    d = sampling.stratified_holdout(d, test_size=test_size, label="is_test", seed=seed, split_col="_adv")
    d = d.withColumn("label", F.col("is_test").cast("double")).persist()
    try:
        m = fit_model(d.where(F.col("_adv") == "train"), ff.feature_cols, spec, cat_cols=ff.cat_cols)
        s = written(score(m, d.where(F.col("_adv") == "test")).select("is_test", "p"), "adversarial")
    finally:
        d.unpersist()
    return metrics.roc_auc(s, "is_test", "p")
