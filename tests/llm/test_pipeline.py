"""The pipeline against its operators' plain versions, and its contract."""

import corpus_pipeline
from hearth.llm import neardup, quality
from hearth.llm.common import staged
from tests.conftest import SF_SMALL
from tests.llm.test_neardup import brute_classes


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "best_fit_packing"]
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_SMALL), name)
        tables.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.count() <= seen
            seen = docs.count()
    ordinary, good, single, packed = tables
    kept = [r.doc_id for r in quality.judge(ordinary).where("kept").collect()]
    assert sorted(kept) == sorted(r.doc_id for r in good.collect())
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(min(c) for c in brute_classes(rows)) == sorted(r.doc_id for r in single.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}
    again = corpus_pipeline.run(spark, SF_SMALL)
    assert again.count() == packed.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_SMALL), name)
    assert docs.count() == 0 and quality.STATS and neardup.BANDS


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for c in ("_row", "key", "_key", "_stats", "_score", "class_id", "kept"):
        docs = docs.withColumn(c, docs["source"])
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = staged(stage(spark, docs, SF_SMALL), "clash")
        assert out.columns == docs.columns
        docs = out
