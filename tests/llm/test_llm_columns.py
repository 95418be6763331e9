"""Columns of the input that have the names of the operators' own, nulls, ties and empty tables in the pipeline's stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillseek.llm import exact_dedup, mixing, packing, quality, queries, simhash

CLASHES = """_word _bits _hash _key _chain _sha _known _known_id _known_sha _one _weight _s _base _threshold _rows _copy _id _row _norm __s __base __threshold
__copies __copy __sha __gone_id __gone_sha __one __id __rejected s n h w rows target base threshold key sha slot bucket keep fp cell component good fit weight bin open task
source_size taken kept""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(i, f"word{i} and more words of document {i} " * 3, "en", f"s{i % 3}", 1) for i in range(40)]
ROWS += [(100 + i, "the same text for all of these rows", "en", "s1", 1) for i in range(10)]
ROWS += [(200, None, None, None, None), (201, "", "en", None, 0), (None, "a text without an id", "en", "s1", 1), (7, ROWS[7][1], "en", "s1", 1), (300, "long " * 60_000, "de", "s2", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for i, name in enumerate(CLASHES):
        frame = frame.withColumn(name, F.lit(f"{name} {i}"))
    return frame.withColumn("a.b`c", F.lit("odd name"))


def checked(found, docs):
    rows = found.collect()
    assert found.columns == docs.columns
    for r in rows:
        assert all(r[c] == f"{c} {i}" for i, c in enumerate(CLASHES)) and r["a.b`c"] == "odd name"
    return rows


def test_every_column_stays(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert checked(quality.keep_good(docs, labels), docs)
    assert len(checked(exact_dedup.drop_copies(docs), docs)) == len({(r[1] or "").lower() for r in ROWS})
    assert checked(simhash.keep_one(docs), docs)
    assert checked(mixing.apply(docs), docs)
    assert {r["doc_id"] for r in packing.pack(docs, queries.vocabulary_path()).collect()} == {r[0] for r in ROWS}


def test_stages_of_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_stages_with_odd_rows(spark, docs):
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, "/root/testdata/sf0.001")
        rows = checked(found, docs)
        assert rows, name
    packed = corpus_pipeline.STAGES[-1][1](spark, found, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in rows}


def exchanges(df):
    """The output of every exchange in the plan, as text."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]


def test_texts_stay_where_they_are_read(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert not exchanges(quality.keep_good(docs, labels))
