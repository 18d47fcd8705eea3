"""Tables that grow with the input are never collected on the driver for a broadcast, whatever size Spark takes them for."""

import pytest

from tallyforge.llm import common, linedup, neardup, rlz, simhash

from ..conftest import SF


@pytest.fixture
def planned(monkeypatch):
    """The plans of all tables that the operators store on the way, as they are before a row is read."""
    plans = []

    def keep(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    real = common.stored
    for module in (common, simhash, linedup, neardup, rlz):
        monkeypatch.setattr(module, "stored", keep)
    return plans


def unbroadcast(df, plans) -> None:
    plans = [*plans, ("result", df._jdf.queryExecution().executedPlan().toString())]
    assert any("SortMergeJoin" in p for _, p in plans)
    assert [n for n, p in plans if "Broadcast" in p] == []


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(200)


def test_fingerprints_are_not_broadcast(spark, planned):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    unbroadcast(simhash.fingerprints(documents(spark)), planned)


def test_stages_of_the_pipeline_are_not_broadcast(spark, planned):
    docs = documents(spark)
    docs = docs.unionByName(docs.limit(20).selectExpr("doc_id + 100000 as doc_id", *(f"`{c}`" for c in docs.columns if c != "doc_id")))
    for stage in (linedup.remove, neardup.keep_first, rlz.remove):
        unbroadcast(stage(docs), planned)
