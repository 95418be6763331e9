"""The queries over the corpus tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillseek.llm import chat, exact_dedup, licences, mixing, neighbours, oracle, packing, quality, simhash, token_store, url_filter
from quillseek.llm._shared import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).taken()


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark)).drop("component")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_embedding_near_dedup,
        op3_source_mixing,
        op4_quality_classifier,
        op5_exact_dedup,
        op6_licence_scan,
        op7_chat_format,
        op8_token_store,
        op9_url_filter,
        op10_simhash_near_dedup,
    )
}

#: Packing and the token store need a tokenizer, SimHash needs XXH64 and the classifier its models: the tests compare those
#: four with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": oracle.NEAR_VECTORS,
    "op3_source_mixing": oracle.MIXING,
    "op5_exact_dedup": oracle.EXACT_DEDUP,
    "op6_licence_scan": oracle.LICENCES,
    "op7_chat_format": oracle.CHAT,
    "op9_url_filter": oracle.URLS,
}
