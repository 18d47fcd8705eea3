"""The whole pipeline on nulls, empty and long texts, repeated rows and clashing columns, and on empty tables."""

import pytest

from tests.llm.test_llm import SCHEMA, edge, empty

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("case", ["edge", "empty"])
def test_pipeline_runs(spark, tmp_path, case):
    import corpus_pipeline as p

    good = " ".join(f"word{k}" for k in range(60))
    if case == "edge":
        docs = edge(spark)
        more = spark.createDataFrame([(20, good, None, None, 1), (21, good, "en", "s", None), (21, good, "en", "s", None), (None, good + " more", None, None, None)], SCHEMA)
        docs = docs.unionByName(more, allowMissingColumns=True)
    else:
        docs = empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (6, 0, None), (None, 1, 0), (20, 1, 0)] if case == "edge" else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    if case == "empty":
        assert out == []
    else:
        # Short texts go; copies of one text stay once.
        ids = {r["doc_id"] for r in out}
        assert 20 in ids and not ids & {1, 2, 5, 6, 7, 8, 21}
        for r in out:
            assert r["length"] > 0 and r["offset"] + r["length"] <= 1024
