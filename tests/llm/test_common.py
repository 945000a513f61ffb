"""Scratch tables, the size of a broadcast, and joins with hot keys."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairnflow.llm import common


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")
    assert common.scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]")), "x").startswith("file:///")


def test_saved_tables_can_be_deleted(spark):
    table = common.saved(spark.range(5), "five")
    path = table.scratch.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    common.forget(table)
    assert not os.path.exists(path)


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(1, "a" * 100, [1, 2, 3]), (2, None, None)], "k bigint, s string, a array<bigint>")
    assert common.value_bytes(rows) == 8 + 100 + 24 + 8 + 8 + 8 and common.value_bytes(rows.limit(0)) == 0
    hinted = lambda limit: "ResolvedHint" in common.broadcast_if_small(rows, limit)._jdf.queryExecution().analyzed().toString()
    assert hinted(200) and not hinted(100)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lookup_keeps_all_rows_of_hot_and_cold_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = common.saved(spark.range(20_000).select(F.when(F.col("id") < 15_000, -1).otherwise(F.col("id")).alias("k"), "id"), "rows")
    table = common.saved(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 19999"), "table")
    found = common.lookup(rows, table, "k", "n", 20_000)
    assert found.count() == 20_000 and found.where("top IS NULL").count() == 1
    assert found.where("k = -1").agg(F.min("top"), F.max("top")).first() == (14_999, 14_999)
