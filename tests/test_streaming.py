from __future__ import annotations

import pytest

from quillseek import Collection, Index
from quillseek.streaming.standing import growing_index, standing_search


def write_batches(spark, path, batches):
    for n, texts in enumerate(batches):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").parquet(f"{path}/b{n}")


def test_standing_search(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [["apple pie", "orange"], ["aple", "banana"]])
    stream = spark.readStream.schema("value string").parquet(f"{tmp_path}/in/*")
    for query, options, expected in (
        ("apple", {"threshold": 0.3}, {"apple pie", "aple"}),
        ("^ap | 'ana", {"use_extended_search": True}, {"apple pie", "aple", "banana"}),
        ({"value": {"$endsWith": "e"}}, {}, {"apple pie", "aple", "orange"}),
    ):
        name = f"found{len(expected)}{len(options)}"
        found = standing_search(stream, query, keys=["value"], **options)
        running = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        running.processAllAvailable()
        running.stop()
        assert {r["item"]["value"] for r in spark.table(name).collect()} == expected


def test_token_search_over_a_stream_needs_a_corpus(spark, tmp_path, strings):
    write_batches(spark, tmp_path / "in", [["red apple", "green pear"]])
    stream = spark.readStream.schema("value string").parquet(f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        standing_search(stream, "apple", keys=["value"], use_token_search=True)
    corpus = Collection.of(strings(["red apple", "red pear", "red plum"]), keys=["value"], use_token_search=True)
    found = standing_search(stream, "red apple", corpus=corpus, keys=["value"], use_token_search=True, threshold=0.2)
    running = found.writeStream.format("memory").queryName("tokens").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    assert [r["item"]["value"] for r in spark.table("tokens").collect()] == ["red apple"]


def test_growing_index(spark, tmp_path, strings):
    write_batches(spark, tmp_path / "in", [["delta", "echo"], ["foxtrot"]])
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    path = str(tmp_path / "index")
    running = growing_index(stream, path, Index.create(["value"], strings(["alpha", "bravo"]))).option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    index = Index.load(spark, path)
    every = Collection.of(None, index=index, keys=["value"]).search("").collect()
    assert [r["ref_index"] for r in every] == [0, 1, 2, 3, 4]
    assert {r["item"]["value"] for r in every} == {"alpha", "bravo", "delta", "echo", "foxtrot"}
