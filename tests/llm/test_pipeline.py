import importlib

import pytest


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark, pipeline, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[0] > seen[1] > 0 and seen[1] >= seen[2] >= seen[3] == seen[4] == seen[5] > 0
    assert {r.doc_id: r.ids for r in pipeline.run(spark, sf).collect()} == {r.doc_id: r.ids for r in docs.collect()}


def test_near_duplicates_keep_one(spark, pipeline):
    rows = [(5, "same text of four words", 1), (2, "Same TEXT of four words", 1), (2, "same text of four words", 1), (9, "another text altogether here", 1), (None, "same text of four words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "9", "None"]


def test_quality_filter_counts_once(spark, pipeline):
    """The filter reads the statistics; it must not compute them again for each condition of each rule."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = pipeline.quality(spark, docs, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("regexp_count") < 30
    assert plan.lstrip().startswith("Project") and "Filter" in plan and "Generate" in plan
