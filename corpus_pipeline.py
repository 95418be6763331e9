"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillseek.llm import exact_dedup, mixing, packing, quality, simhash
from quillseek.llm._shared import materialise, table
from quillseek.llm.queries import vocabulary_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles have a Jaccard similarity of 0.8 or more are near copies."""
    return simhash.keep_dissimilar(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes twice are two rows."""
    return mixing.apply(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoder remembers less than by default: the executors' heaps are full from the stages before."""
    return packing.pack(docs, vocabulary_path(), remembered=100_000)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Packing encodes texts with a tokenizer, which SQL can't express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
