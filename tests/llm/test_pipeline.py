import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_stages(spark):
    import corpus_pipeline as c

    from maxentnet.llm import _work

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (None, "alone with a null id", None, "x", 20)], docs.schema)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = docs.union(odd).union(docs.limit(1))
    for name, stage in c.STAGES:
        new = _work.written(stage(spark, docs, SMALL), "stage")
        if name != "packing":
            assert new.columns == list(c.COLUMNS)
        if name in ("toxicity", "near duplicates"):
            assert all(before[r["doc_id"]] == r["text"] for r in new.filter("doc_id < 1000000").collect())
        if name == "near duplicates":
            assert new.filter("doc_id IS NULL").count() == 2 and new.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
        if name == "mix":
            words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
            assert abs(words(new) - words(docs)) <= 25
        docs = new
    assert docs.count() > 100
    for _, stage in c.STAGES[1:]:
        assert stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0), SMALL).count() == 0
