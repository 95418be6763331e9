"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000
#: A key is hot if it holds more than one in HOT_SHARE rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500
#: A filter of keys has at most 2^FILTER_BITS rows of 64 bits, whatever it was made from.
FILTER_BITS = 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word, as the contracts of the corpus queries define it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that are turned into Python strings at once, and rows that Spark sends at once.
SLICE_ROWS = 256
BATCH_ROWS = 512

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one that driver and executors share."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="quillseek-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df below the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(conf).delete(path, True)


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Names that no column of df has in any case, one for each label."""
    taken, out = {c.lower() for c in df.columns}, []
    for label in labels:
        while label.lower() in taken:
            label = "_" + label
        taken.add(label.lower())
        out.append(label)
    return out


def _mask(h: Column) -> Column:
    def bit(at: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))

    return bit(0).bitwiseOR(bit(6))


def key_filter(hashes: Column, keys: DataFrame) -> DataFrame:
    """A Bloom filter of 64-bit hashes as at most 2^FILTER_BITS rows (word, bits): two bits in one word for each hash."""
    each = keys.select(hashes.alias("h")).select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("word"), _mask(F.col("h")).alias("bits"))
    return each.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def split(docs: DataFrame, h: Column, keys: DataFrame, hashes: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose hash `h` may be one of keys' `hashes`, and the rows whose hash isn't.  No row of docs moves.

    The filter is broadcast; it has a fixed size, so a table with very many keys only makes the first part longer than it need be.
    """
    own, word, bits = fresh(docs, "_hash", "_word", "_bits")
    words = F.broadcast(key_filter(hashes, keys).withColumnsRenamed({"word": word, "bits": bits}))
    probed = docs.withColumn(own, h).withColumn(word, F.shiftrightunsigned(own, 64 - FILTER_BITS))
    hit = F.col(bits).bitwiseAND(_mask(F.col(own))) == _mask(F.col(own))
    maybe = probed.join(words, word).where(hit)
    others = probed.join(words, word, "left").where(~F.coalesce(hit, F.lit(False)))
    return maybe.select(columns_of(docs)), others.select(columns_of(docs))


def without(docs: DataFrame, gone: DataFrame, on: dict[str, Column], probe: tuple[Column, Column] | None = None) -> DataFrame:
    """The rows of docs of which `on` gives no row of gone: gone's columns and what they are in docs; null equals null.

    Only rows that pass a filter of gone's keys are shuffled; the others stay where they are read.  probe: a hash of the keys in
    docs and in gone, where one is known that takes less work than hashing `on`.
    """
    own, theirs = probe or (F.xxhash64(*on.values()), F.xxhash64(*map(F.col, on)))
    maybe, kept = split(docs, own, gone, theirs)
    *names, found = fresh(docs, *on, "_found")
    known = gone.select([F.col(n).alias(a) for n, a in zip(on, names, strict=True)]).distinct().withColumn(found, F.lit(True))
    same = [value.eqNullSafe(F.col(a)) for a, value in zip(names, on.values(), strict=True)]
    # Not an anti join: the optimizer moves those below the filter's join, where all rows would be shuffled.
    return kept.unionByName(maybe.join(known, same, "left").where(F.col(found).isNull()).select(columns_of(docs)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have few rows, else df as it is: a shuffle join then."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "left", share: int = HOT_SHARE) -> DataFrame:
    """left join right, where right has one row per key and `weight` rows of left have that key.

    The hot keys, fewer than `share`, are broadcast; the rest is joined by a shuffle, in which no key
    has more than one in `share` rows.  Keys may not be null.
    """
    limit = max(1, total // share)
    hot = right.where(F.col(weight) > limit)
    cold = right.where(F.col(weight) <= limit)
    keys = F.broadcast(hot.select(*on))
    out = left.join(keys, on, "left_semi").join(F.broadcast(hot), on, how)
    return out.unionByName(left.join(keys, on, "left_anti").join(cold, on, how))


def ascii_lower(column):
    """A-Z lower-cased, nothing else changed."""
    return F.translate(column, UPPER, LOWER)


def ascii_lower_text(column):
    """The same for a plain column of long texts: most of them are ASCII only, where lower() does it faster."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(ascii_lower(column))


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, Spark sends few rows at once to Python: texts can be long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small pieces of the batches with their texts; null texts are empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield part, [t or "" for t in part.column("text").to_pylist()]
    pa.default_memory_pool().release_unused()
