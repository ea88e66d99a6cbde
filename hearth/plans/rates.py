"""A classifier without iterations: the class rate of a row's category.

``CategoryRate`` is a ``pyspark.ml`` estimator whose fit is one aggregate, so that
the drivers (folds, resampling, fit, score, metrics) can be recomputed in SQL to
the last row, and an example of a classifier that a user brings along.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.operators import joins
from hearth.session import written


class _RateParams(HasLabelCol):
    category = Param(Params._dummy(), "category", "column of the category", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "rows that the overall rate counts for", TypeConverters.toFloat)


class CategoryRate(Estimator, _RateParams):
    """P(1) = (ones + weight * overall rate) / (rows + weight) of the category's training rows;
    NULL and unseen categories get the overall rate. The rates are a written table, joined by
    category, so any number of categories will do."""

    def __init__(self, category: str, label: str = "label", weight: float = 10.0) -> None:
        super().__init__()
        self._set(category=category, labelCol=label, weight=weight)

    def _fit(self, df: DataFrame) -> CategoryRateModel:
        category, y = self.getOrDefault("category"), F.col(self.getLabelCol()).cast("long")
        rates = written(df.groupBy(F.col(category).alias("__category")).agg(
            F.sum(y).alias("__ones"), F.count(y).alias("__rows")), "rates")
        total = rates.agg(F.sum("__ones").alias("ones"), F.sum("__rows").alias("rows")).first()
        prior = total.ones / total.rows if total.rows else 0.0
        return self._copyValues(CategoryRateModel(rates, prior))


class CategoryRateModel(Model, _RateParams):
    """Adds ``probability`` (a vector, like Spark's own classifiers) and ``prediction``."""

    def __init__(self, rates: DataFrame, prior: float) -> None:
        super().__init__()
        self.rates, self.prior = rates, prior

    def _transform(self, df: DataFrame) -> DataFrame:
        category, weight = self.getOrDefault("category"), F.lit(self.getOrDefault("weight"))
        rate = self.rates.select("__category", ((F.col("__ones") + weight * self.prior) / (F.col("__rows") + weight)).alias("__rate"))
        out = joins.map_lookup(df, category, rate, "__category", "__rate", out_col="__p")
        p = F.coalesce("__p", F.lit(self.prior))
        return (out.withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("__p"))
