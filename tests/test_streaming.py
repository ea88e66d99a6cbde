"""A fitted model scores a file stream of households (stream-static join for num_indiv)."""

import tempfile

from pyspark.sql import functions as F

from hearth.operators import joins
from hearth.plans.models import fit_model
from hearth.sources.tables import households, individuals
from hearth.streaming import read_household_stream, score_stream, write_scores
from tests.conftest import SF_SMALL


def test_stream_scoring(spark):
    h, i = households(spark, SF_SMALL), individuals(spark, SF_SMALL)
    counts = i.groupBy("id").agg(F.count(F.lit(1)).alias("num_indiv"))
    tr = joins.num_indiv(h.where(F.col("_split") == "train"), i).withColumn("label", F.col("poor").cast("double"))
    tr = tr.withColumn("num_indiv", F.col("num_indiv").cast("double"))
    model = fit_model(tr, ["num_indiv"], {"kind": "logistic", "C": 1.0})

    src = tempfile.mkdtemp(prefix="hearth-stream-src-")
    h.write.mode("overwrite").parquet(src)
    stream = read_household_stream(spark, src, h.schema)

    def prepare(df):
        return (df.join(counts, "id", "left")
                .withColumn("num_indiv", F.coalesce(F.col("num_indiv"), F.lit(0)).cast("double")))

    scored = score_stream(model, stream, prepare)
    out = tempfile.mkdtemp(prefix="hearth-stream-out-")
    q = write_scores(scored, out + "/data", out + "/ckpt", ["id", "country", "p"])
    q.awaitTermination(120)
    res = spark.read.parquet(out + "/data")
    assert res.count() == h.count()
    assert res.where((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
