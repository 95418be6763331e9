from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillseek.llm import _shared


def test_hot_keys_join_like_any_other(spark):
    left = spark.createDataFrame([(1, "hot")] * 2000 + [(i, f"k{i}") for i in range(50)] + [(0, None), (7, "nowhere")], "v long, k string")
    right = spark.createDataFrame([("hot", "H", 2000)] + [(f"k{i}", f"K{i}", 1) for i in range(50)], "k string, w string, n long")
    for how in ("left", "inner"):
        got = _shared.join_hot(left, right, ["k"], "n", left.count(), how).select("v", "k", "w").collect()
        expected = left.join(right.drop("n"), "k", how).select("v", "k", "w").collect()
        assert sorted(map(str, got)) == sorted(map(str, expected))
    plan = _shared.join_hot(left, right, ["k"], "n", 2052)._jdf.queryExecution().toString()
    assert "broadcast" in plan.lower()


def test_only_small_sides_are_broadcast(spark):
    rows = spark.range(50)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(_shared.small(rows, 50)) and not hinted(_shared.small(rows, 49))


def test_rows_leave_without_moving_the_others(spark):
    docs = spark.range(20_000).select((F.col("id") % 10_000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("_word"), F.lit(2).alias("_bits"), F.lit(3).alias("_hash"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 1, 2, 3)], "doc_id long, text string, _word int, _bits int, _hash int"))
    gone = spark.createDataFrame([(i,) for i in range(0, 1000, 10)] + [(None,), (10_000_000,)], "doc_id long")
    maybe, others = _shared.split(docs, F.xxhash64("doc_id"), gone, F.xxhash64("doc_id"))
    assert 201 <= maybe.count() < 400 and maybe.count() + others.count() == 20_001 and maybe.columns == others.columns == docs.columns
    left = _shared.without(docs, gone, {"doc_id": F.col("doc_id")})
    assert left.columns == docs.columns and left.count() == 19_800
    assert left.where("doc_id IS NULL OR doc_id % 10 = 0 AND doc_id < 1000").isEmpty()
    assert _shared.without(docs, gone.limit(0), {"doc_id": F.col("doc_id")}).count() == 20_001
    assert _shared.without(docs.limit(0), gone, {"doc_id": F.col("doc_id")}).count() == 0


def test_only_rows_that_pass_the_filter_are_joined(spark):
    """The join with the keys is above the one with the filter, so its exchange has no other rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
        gone = _shared.materialise(spark.range(0, 5000, 50).select(F.col("id").alias("doc_id")), "gone")
        left = _shared.without(docs, gone, {"doc_id": F.col("doc_id")})
        lines = left._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins = [line.lstrip(" :+-") for line in lines if "Join " in line]
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines if "Join " in line]
        at = next(i for i, j in enumerate(joins) if "<=>" in j)
        below = next(i for i, j in enumerate(joins) if j.startswith("Join Inner") and "_word" in j)
        assert below > at and depth[below] > depth[at] and left.count() == 4900
        moved = left._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" not in moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_filter_has_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(_shared, "FILTER_BITS", 6)
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    assert _shared.key_filter(F.col("h"), keys).count() == 64
    docs = spark.range(10_000)
    assert sorted(r[0] for r in _shared.without(docs, docs.where("id % 3 = 0"), {"id": F.col("id")}).collect()) == [i for i in range(10_000) if i % 3]


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("_A"), F.lit(2).alias("__a"), F.lit(3).alias("x`y.z"))
    assert _shared.fresh(df, "_a", "b", "b") == ["___a", "b", "_b"]
    assert df.select(_shared.columns_of(df)).columns == df.columns


def test_materialised_tables_can_be_forgotten(spark):
    df = _shared.materialise(spark.range(10), "t")
    files = df.inputFiles()
    assert df.count() == 10 and files and _shared.shared_dir(spark).removeprefix("file:") in files[0]
    _shared.forget(df)
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()
    empty = _shared.materialise(spark.range(0), "t")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_small_batches_restore_the_setting(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), _shared.small_batches(spark):
        assert spark.conf.get(key) == str(_shared.BATCH_ROWS)
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_slices_and_folding(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([None if i % 2 else f"t{i}" for i in range(600)])], ["doc_id", "text"])
    parts = list(_shared.slices(iter([batch])))
    assert [len(t) for _, t in parts] == [256, 256, 88] and parts[0][1][:3] == ["t0", "", "t2"]
    assert spark.range(1).select(_shared.ascii_lower(F.lit("ÀZaé"))).first()[0] == "Àzaé"
