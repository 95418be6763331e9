"""Searches over streams.

A match depends on its record alone, so a standing search is a stateless select over the stream.  Token search needs
the frequencies of words in a whole collection; they are taken from a stored one when the search starts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillseek.options import Options, options_of
from quillseek.plans.search import Collection
from quillseek.sources.index import ORDINAL, Index


def standing_search(stream: DataFrame, query: str | dict, options: Options | None = None, corpus: Collection | None = None, **changes) -> DataFrame:
    """The records of a stream that match, as they come: item, ref_index (null if the stream has none), score and, if wanted, matches."""
    if ORDINAL not in stream.columns:
        stream = stream.withColumn(ORDINAL, F.lit(None).cast("long"))
    chosen = options_of(options, changes)
    if isinstance(query, str) and chosen.use_token_search and corpus is None:
        raise ValueError("token search over a stream needs a corpus for the frequencies of words")
    return Collection.of(stream, chosen).matches(query, corpus)


def growing_index(stream: DataFrame, path: str, first: Index) -> DataStreamWriter:
    """A writer that appends each batch of a stream to the index stored at path, which starts as `first`.

    Each batch's records are written with the batch's number, so a batch that runs again replaces its own files.
    """
    first.save_keys(path)
    first.frame.write.mode("overwrite").parquet(f"{path}/records/batch=-1")
    names = [f.name for f in first.frame.schema["item"].dataType.fields]

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{path}/records").where(F.col("batch") < number).drop("batch")
        last = stored.agg(F.max(ORDINAL)).first()[0]
        before = replace(first, frame=stored.where(F.col(ORDINAL) == F.lit(last)), source=None, words=None)
        grown = before.add(batch.select(names)).frame.where(F.col(ORDINAL) > F.lit(-1 if last is None else last))
        grown.write.mode("overwrite").parquet(f"{path}/records/batch={number}")

    return stream.writeStream.foreachBatch(append)
