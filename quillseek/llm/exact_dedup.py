"""Exact deduplication with an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised texts.  A directory of 2^depth slots maps a key's leading bits, its slot, to its
bucket.  The directory doubles while a slot has more than `bucket_keys` distinct keys; slots that don't need its full depth
share a bucket with their buddies, as they would if only overfull buckets had split.  Slots are counted and buckets are
formed as DataFrames; the driver sees the depth and the size of the largest slot.  Buckets are PAGES-fold larger for very many keys,
so that the directory never has more rows than may be broadcast.

Texts whose key occurs more than once are compared by all their bytes: a filter of those keys, of a fixed size, is
broadcast, so no other text moves (but for a few that the filter lets pass), and equal texts become one in each task before
they move, so a text that fills a third of a table costs one row per task.  The entries then go to the owners of their buckets: a task
has ranges of keys, chains the texts that share a key and writes entries in the order of keys below the shared folder.  Rows find
their entry through the directory: by slot, bucket, key and digest.

Everything runs as DataFrame operations.  Two different texts with the same key and the same SHA-256 would make the
operator fail rather than merge them.

Defined results: null text counts as empty; texts are equal when they are identical after A-Z are lower-cased; of
equal texts the row with the largest id stays, null ids being the smallest; of rows that repeat an id and a text
one stays; very long texts are hashed and compared whole; an empty table gives an empty result; other columns, whatever
their names, pass through `drop_copies`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillseek.llm._shared import HOT_SHARE, ascii_lower_text, columns_of, fresh, join_hot, materialise, small, split, without

#: Distinct keys in a bucket, at most.
BUCKET_KEYS = 50_000
#: Buckets are larger if there would be more than about this many of them.
PAGES = 1 << 16
#: Bits of a key that can tell slots apart: all of them but the sign of a long.
MAX_DEPTH = 62


def normalised(text: str | Column = "text") -> Column:
    return F.coalesce(ascii_lower_text(F.col(text) if isinstance(text, str) else text), F.lit(""))


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def key_of(norm: Column, bits: int = 64) -> Column:
    """The key of a normalised text; fewer bits make keys collide, for tests."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(h, 64 - bits)


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[int, DataFrame]:
    """The depth, and slot, bucket (its first slot) and n (the bucket's keys) for each slot that has keys.  keys: distinct keys."""
    count = keys.count()
    page = max(bucket_keys, count // PAGES)
    depth = math.ceil(math.log2(count / page)) if count > page else 0
    while True:
        slots = materialise(keys.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
        fullest = slots.agg(F.max("n")).first()[0] or 0
        if depth == MAX_DEPTH or fullest <= page:
            break
        depth = min(MAX_DEPTH, depth + math.ceil(math.log2(fullest / page)))
    # The largest aligned block of slots around a slot whose keys fit in one bucket.
    blocks = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("merged"))
    blocks = blocks.withColumn("first", F.expr("shiftleft(shiftright(slot, merged), merged)"))
    sizes = blocks.groupBy("merged", "first").agg(F.sum("n").alias("keys")).where((F.col("keys") <= page) | (F.col("merged") == 0))
    largest = blocks.join(sizes, ["merged", "first"]).groupBy("slot").agg(F.max(F.struct("merged", F.col("first").alias("bucket"), F.col("keys").alias("n"))).alias("b"))
    return depth, materialise(largest.select("slot", "b.bucket", "b.n"), "dedup-directory")


@dataclass
class Index:
    """rows: each row's id, place, key and digest.  entries: bucket, key, chain (its place among the texts of its key), sha, n and the
    row that stays, for texts with copies.  slots: the directory."""

    rows: DataFrame
    entries: DataFrame
    slots: DataFrame
    depth: int
    total: int

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows, which have a key, with the bucket that the directory gives for it."""
        slots = small(self.slots.select("slot", "bucket"), 8 * PAGES)
        return rows.withColumn("slot", slot_of(F.col("key"), self.depth)).join(slots, "slot").drop("slot")

    def result(self) -> DataFrame:
        """_id, _row, sha, keep_id, keep_row, group_size for each row."""
        joined = join_hot(self.routed(self.rows), self.entries.drop("chain"), ["bucket", "key", "sha"], "n", self.total)
        return joined.select(
            "_id", "_row", "key", "sha",
            F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("keep._id")).alias("keep_id"),
            F.coalesce("keep._row", "_row").alias("keep_row"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
        )


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, bucket_keys: int = BUCKET_KEYS) -> Index:
    norm = normalised(text_col)
    texts = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("key", key_of(F.col("_norm"), bits))
    rows = materialise(texts.select("_id", "key", digest_of(F.col("_norm")).alias("sha"), F.monotonically_increasing_id().alias("_row")), "dedup-rows")
    groups = rows.groupBy("key", "sha").agg(F.count("*").alias("n"), F.max(F.struct("_id", "_row")).alias("keep"))
    groups = materialise(groups, "dedup-groups")
    keys = groups.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    keys = materialise(keys, "dedup-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    depth, slots = directory(keys, bucket_keys)

    again = keys.where("n > 1").select("key")
    candidates, _ = split(texts.select("key", "_norm"), F.xxhash64("key"), again, F.xxhash64("key"))
    compared = candidates.groupBy("key", "_norm").agg(F.count("*").alias("n")).select("key", digest_of(F.col("_norm")).alias("sha"), F.col("n").alias("equal"))
    index = Index(rows, groups, slots, depth, total)
    owned = index.routed(compared).repartition("bucket")
    order = Window.partitionBy("bucket", "key").orderBy("sha")
    twice = F.coalesce(F.lag("sha").over(order) == F.col("sha"), F.lit(False))
    chained = owned.withColumn("chain", F.row_number().over(order)).withColumn("twice", twice)
    named = chained.join(index.routed(groups.where("n > 1")), ["bucket", "key", "sha"])
    different = F.raise_error(F.lit("different texts share a key and a SHA-256")).cast("long")
    named = named.select("bucket", "key", "chain", "sha", F.when(F.col("twice") | (F.col("equal") != F.col("n")), different).otherwise(F.col("n")).alias("n"), "keep")
    index.entries = materialise(named.sortWithinPartitions("bucket", "key", "chain"), "dedup-index")
    return index


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return build(docs).result().select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows of the few texts with very many copies are decided where they are read; of the others only those move that a
    filter of dropped rows lets pass.
    """
    index = build(docs, id_col, text_col)
    gone = index.result().where("_row != keep_row").groupBy("_id", "key", "sha").agg(F.max(F.expr("_id <=> keep_id")).alias("repeated"))
    gone = materialise(gone, "dedup-gone")
    norm, key_name, chain = normalised(text_col), *fresh(docs, "_key", "_chain")
    own_id = F.col(f"`{id_col}`")
    hot = index.entries.where(F.col("n") > index.total // HOT_SHARE)  # fewer than HOT_SHARE rows
    hot = hot.groupBy(F.col("key").alias(key_name)).agg(F.collect_list(F.struct("sha", F.col("keep._id").alias("id"))).alias(chain))
    marked = docs.withColumn(key_name, key_of(norm)).join(F.broadcast(hot), key_name, "left")
    copy = F.when(F.col(chain).isNotNull(), F.exists(chain, lambda c: (c["sha"] == digest_of(norm)) & ~c["id"].eqNullSafe(own_id)))
    cold = marked.where(~F.coalesce(copy, F.lit(False))).select(key_name, *columns_of(docs))

    def probe(key: str | Column, row_id: str | Column) -> Column:
        return F.xxhash64(key, row_id)

    ids = {"_id": own_id, "sha": digest_of(norm)}
    kept = without(cold, gone, ids, (probe(key_name, own_id), probe("key", "_id"))).select(columns_of(docs))
    repeated = gone.where("repeated")
    if repeated.isEmpty():
        return kept
    # Rows that repeat both id and text: one of each stays.
    maybe, _ = split(cold, probe(key_name, own_id), repeated, probe("key", "_id"))
    sha, known_id, known_sha, row = fresh(docs, "_sha", "_known_id", "_known_sha", "_one")
    maybe = maybe.withColumn(sha, digest_of(norm)).groupBy(own_id, sha).agg(F.first(F.struct(columns_of(docs))).alias(row))
    known = repeated.select(F.col("_id").alias(known_id), F.col("sha").alias(known_sha))
    one = maybe.join(known.distinct(), own_id.eqNullSafe(F.col(known_id)) & (F.col(sha) == F.col(known_sha))).select(F.col(f"{row}.*"))
    return kept.unionByName(one)
