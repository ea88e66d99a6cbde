"""Scoring a stream of households with a fitted model (M8 on a streaming frame).

The reference is batch only; the one streaming use is the by-product that a
fitted ``PipelineModel`` is a pure projection, so it applies unchanged to a
``readStream`` frame. Feature preparation for a stream must therefore also
be a projection or a stream-static join (e.g. household sizes counted once
from the static individual table), never a fit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hearth.plans.models import score


def read_household_stream(spark: SparkSession, path: str, schema: StructType,
                          max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream of household rows (parquet) with a fixed schema."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def score_stream(model: PipelineModel, stream: DataFrame,
                 prepare: Callable[[DataFrame], DataFrame] | None = None, out: str = "p") -> DataFrame:
    """Apply ``prepare`` (projection / stream-static join) and the fitted model."""
    prepared = prepare(stream) if prepare is not None else stream
    return score(model, prepared, out=out)


def write_scores(scored: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Append the scores to a parquet sink; the checkpoint (in the shared
    folder) makes the query restartable after a failure with exactly-once
    file output. ``availableNow`` processes what is there and stops."""
    out = scored.select(*columns) if columns else scored
    return (out.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))
