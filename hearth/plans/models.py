"""Model construction and scoring on ``pyspark.ml``.

Parameter map from the reference's boosting library to ``GBTClassifier``
(SURVEY 4.3): ``n_estimators -> maxIter``, ``max_depth -> maxDepth``,
``subsample -> subsamplingRate``, ``random_state -> seed``,
``min_child_weight -> minInstancesPerNode`` (rows rather than hessian sum),
learning rate stays the library default 0.1 stated explicitly; ``reg_alpha``
and ``reg_lambda`` have no counterpart and are ignored. Node-id caching is
used only for deep trees (> 8 levels), where it pays off; shallow trees are
cheaper to ship to the executors. Every 10 iterations the boosting state is
checkpointed into the shared folder, which bounds the lineage of 400-tree fits.

Training rows are dealt by a hash of their id into as many partitions as their
bytes need, and sorted inside. A fit's jobs (one a tree level) then have one task
on small data (a task costs Spark ML as much as some 50,000 rows) and several on
larger, and bags, which Spark ML draws by partition, are the same for
every layout of the input.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.exprs import logistic, prob_of_class
from hearth.session import checkpoint_root

#: Bytes of training values (8 each) that a partition of a fit holds.
PARTITION_BYTES = 32 << 20
#: The first partitions of a fit hold less, so that its jobs use several cores: up to so many of so many bytes.
FIRST_PARTITIONS, FIRST_BYTES = 4, 8 << 20


def make_estimator(spec: dict, n_rows: int | None = None, features: str = "features",
                   label: str = "label") -> Estimator:
    """Build a classifier from a recipe's model spec."""
    kind = spec.get("kind", "gbt")
    if kind == "gbt":
        return GBTClassifier(featuresCol=features, labelCol=label,
                             maxIter=int(spec.get("n_estimators", 100)), maxDepth=int(spec.get("max_depth", 5)),
                             subsamplingRate=float(spec.get("subsample", 1.0)),
                             minInstancesPerNode=int(spec.get("min_child_weight", 1)),
                             stepSize=float(spec.get("learning_rate", 0.1)), seed=int(spec.get("seed", 0)),
                             cacheNodeIds=int(spec.get("max_depth", 5)) > 8, checkpointInterval=10)
    if kind == "logistic":
        # the reference's l2 penalty with strength C on the summed loss equals
        # regParam = 1 / (C * n) on Spark's mean loss, without standardisation
        if n_rows is None:
            raise ValueError("logistic needs n_rows to translate C")
        # (tolerance 1e-4 and 100 iterations: the reference library's defaults)
        return LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0,
                                  regParam=1.0 / (float(spec.get("C", 1.0)) * n_rows),
                                  standardization=False, maxIter=int(spec.get("max_iter", 100)),
                                  tol=float(spec.get("tol", 1e-4)))
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label,
                                      numTrees=int(spec.get("n_estimators", 100)),
                                      maxDepth=int(spec.get("max_depth", 5)), seed=int(spec.get("seed", 0)),
                                      cacheNodeIds=int(spec.get("max_depth", 5)) > 8, checkpointInterval=10)
    if kind == "linear_svc":
        return LinearSVC(featuresCol=features, labelCol=label, regParam=float(spec.get("reg", 0.0)),
                         maxIter=int(spec.get("max_iter", 100)))
    raise ValueError(f"unknown model kind {kind!r}")


def assemble(feature_cols: Sequence[str], out: str = "features") -> VectorAssembler:
    """Dense assembly of prepared numeric columns (NULLs must be filled first, ledger D20)."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="error")


def sparse_encoder_stages(cat_cols: Sequence[str], num_cols: Sequence[str], out: str = "features") -> list:
    """Wide-data path: ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``.
    The dropped last slot is the NULL/unseen bucket, so NULL and categories not
    seen in training encode as all zeros (``get_dummies`` semantics) in a sparse
    vector; numeric columns (already imputed) are appended."""
    idx = [f"__{c}_idx" for c in cat_cols]
    ohe = [f"__{c}_ohe" for c in cat_cols]
    stages = []
    if cat_cols:
        stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*ohe, *num_cols], outputCol=out, handleInvalid="error"))
    return stages


def dealt(train: DataFrame, n_rows: int, n_values: int, key: Sequence[str] = ("id", "_draw")) -> DataFrame:
    """``train`` in partitions of about ``PARTITION_BYTES`` (``FIRST_BYTES``, while there are few), rows placed by
    a hash of ``key`` and sorted by it: the same partitions whatever the layout of the input. Frames without the
    key columns are left as they are."""
    by = [c for c in key if c in train.columns]
    if not by:
        return train
    size = n_rows * max(1, n_values) * 8
    parts = max(1, math.ceil(size / PARTITION_BYTES), min(math.ceil(size / FIRST_BYTES), FIRST_PARTITIONS))
    return train.repartition(parts, *by).sortWithinPartitions(*by)


def fit_model(train: DataFrame, feature_cols: Sequence[str], spec: dict | Estimator, label: str = "label",
              cat_cols: Sequence[str] = ()) -> PipelineModel:
    """Fit ``assemble -> classifier`` on prepared training rows (with the
    sparse categorical encoder in front when ``cat_cols`` are given).
    ``spec`` is a model spec (see ``make_estimator``) or any ``pyspark.ml``
    classifier reading ``features``/``label`` (the model plug-in surface).

    The rows are counted, dealt (``dealt``), checkpointed to the shared folder and persisted:
    each of the fit's many small jobs then ships a short lineage instead of the whole
    feature plan, and a lost executor's rows come back from files.
    """
    checkpoint_root(train.sparkSession)
    owned = not train.is_cached  # a frame the caller persisted stays persisted
    rows = train.persist() if owned else train
    n = rows.count()
    if not isinstance(spec, Estimator):  # a caller's classifier may read other columns as well
        keys = [c for c in ("id", "_draw") if c in train.columns]
        train = train.select(*dict.fromkeys([*keys, *cat_cols, *feature_cols, label]))
    cached = dealt(train, n, len(feature_cols) + 8 * len(cat_cols)).checkpoint().persist()
    if owned:
        rows.unpersist()
    try:
        est = spec if isinstance(spec, Estimator) else make_estimator(spec, n_rows=n, label=label)
        front = sparse_encoder_stages(cat_cols, feature_cols) if cat_cols else [assemble(feature_cols)]
        pipe = Pipeline(stages=[*front, est])
        return pipe.fit(cached)
    finally:
        cached.unpersist()


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """M8 ``predict_proba(...)[:, 1]``: P(class 1) as a double column. For a
    margin-only model (LinearSVC) the logistic of the margin is used."""
    pred = model.transform(df)
    pred = pred.drop(*[c for c in pred.columns if c.startswith("__") and c.endswith(("_idx", "_ohe"))])
    if "probability" in pred.columns:
        return pred.withColumn(out, prob_of_class("probability", 1)).drop(
            "features", "rawPrediction", "probability", "prediction")
    return pred.withColumn(out, logistic(prob_of_class("rawPrediction", 1))).drop(
        "features", "rawPrediction", "prediction")


def score_routed(models: Mapping[object, PipelineModel], df: DataFrame, route: Column, out: str) -> DataFrame:
    """``out``: P(class 1) by the model whose key equals ``route``, the model under ``None`` for
    rows whose ``route`` is null. One projection: a row is scored by its own model only."""
    columns = df.columns
    chosen = None
    for i, (key, model) in enumerate(models.items()):
        *front, last = model.stages
        last = last.copy()
        name = f"__score{i}"
        read = next((p for p in ("probabilityCol", "rawPredictionCol") if last.hasParam(p)), None)
        probability = read != "rawPredictionCol"
        if read:  # only the column that is read, straight from the features
            for param in ("rawPredictionCol", "predictionCol", "probabilityCol"):
                if last.hasParam(param):
                    last.set(last.getParam(param), name if param == read else "")
        scored = PipelineModel([*front, last]).transform(df)
        df = scored.select(*columns, F.col(name if read else "probability").alias(name))
        columns = [*columns, name]
        value = prob_of_class(name, 1) if probability else logistic(prob_of_class(name, 1))
        hit = route.isNull() if key is None else route == F.lit(key)
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return df.withColumn(out, chosen).drop(*(c for c in columns if c.startswith("__score")))


def label_column(df: DataFrame, target: str = "poor", label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(target).cast("double"))
