"""Token search: words of a query, weighted by how few texts have them."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.functions import text as tx
from quillseek.options import Options


def tokenize(text: str, options: Options) -> list[str]:
    """The tokens of a query."""
    folded = tx.fold(text, options.is_case_sensitive, options.ignore_diacritics)
    if callable(options.tokenize):
        return _checked(options.tokenize(folded))
    return [m.group(0) for m in regex.finditer(options.tokenize or tx.TOKEN, folded)]


def _checked(found) -> list[str]:
    if not isinstance(found, list) or any(not isinstance(t, str) for t in found):
        raise TypeError("a tokenize function must return a list of strings")
    return found


def token_column(folded: Column, options: Options) -> Column:
    """The tokens of a folded text."""
    if callable(options.tokenize):
        return _tokenizer(options.tokenize)(folded)
    return tx.tokens(folded, options.tokenize or tx.TOKEN)


def _tokenizer(function: Callable[[str], list[str]]):
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        encoded = texts.dictionary_encode()  # equal texts are split once
        split = [_checked(function(t)) for t in encoded.dictionary.to_pylist()]
        return pa.array(split, pa.list_(pa.string())).take(encoded.indices)

    return run


def text_tokens(texts: DataFrame, options: Options) -> DataFrame:
    """texts: one folded text per row, in column f.  Adds `tokens`."""
    return texts.withColumn("tokens", token_column(F.col("f"), options))


def document_frequency(texts: DataFrame, options: Options) -> DataFrame:
    """term, df: in how many texts each token occurs."""
    return text_tokens(texts, options).select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def field_count(texts: DataFrame, options: Options) -> DataFrame:
    """field_count: how many texts have a token."""
    return text_tokens(texts, options).agg(F.count(F.when(F.size("tokens") > 0, 1)).alias("field_count"))


def word_table(texts: DataFrame, options: Options) -> DataFrame:
    """term, df: in how many texts each token occurs, and, under the term null, how many texts have a token."""
    some = text_tokens(texts, options).where(F.size("tokens") > 0)
    each = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    return some.select(F.explode(each).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def combined(words: DataFrame, more: DataFrame, sign: int) -> DataFrame:
    """A word table with the counts of another added (1) or taken away (-1); words without texts are left out."""
    both = words.unionByName(more.select("term", (F.col("df") * sign).alias("df")))
    return both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def looked_up(words: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """As `statistics`, from a word table."""
    found = {r["term"]: r["df"] for r in words.where(F.col("term").isNull() | F.col("term").isin(list(dict.fromkeys(terms)))).collect()}
    return found.get(None, 0), {t: found.get(t, 0) for t in terms}


def signature(options: Options) -> tuple | None:
    """The options that decide how texts are split; None if that can't be compared."""
    if callable(options.tokenize):
        return None
    return options.is_case_sensitive, options.ignore_diacritics, options.tokenize


def statistics(texts: DataFrame, terms: list[str], options: Options) -> tuple[int, dict[str, int]]:
    """The number of texts with a token, and in how many each of the terms occurs: one aggregate without a shuffle of words."""
    distinct = list(dict.fromkeys(terms))
    sums = [F.count(F.when(F.array_contains("tokens", t), 1)).alias(f"t{i}") for i, t in enumerate(distinct)]
    row = text_tokens(texts, options).agg(F.count(F.when(F.size("tokens") > 0, 1)).alias("n"), *sums).first()
    return row["n"], {t: row[f"t{i}"] for i, t in enumerate(distinct)}


def idf(count: int, df: int) -> float:
    return math.log(1 + (count - df + 0.5) / (df + 0.5))
