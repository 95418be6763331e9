"""Indexes: the texts of a collection's keys with their length norms, and changes to them.

An index is a DataFrame with one row per record: `ref_index`, the record's ordinal; `item`, the record itself; and for each key
`k0`, `k1`, ... an array of texts.  A list of strings has one key without id and weight, and
blank strings have no row.  Ordinals are stored, so they don't depend on how a table is read.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillseek import errors
from quillseek.sources.keys import Key, keys_to_json, parse_keys, plain_column, texts_of

ORDINAL = "ref_index"
#: Ordinals to remove that are compared with each record's; more of them are joined.
FEW = 100


def with_ordinals(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """df with ref_index 0, 1, ... in the order of `order_by`, which should name a row uniquely.

    Rows are range-partitioned and sorted within their partitions, and then numbered where they are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered_in_place(df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by))


def numbered_in_place(df: DataFrame) -> DataFrame:
    """df with ref_index 0, 1, ... in the order of its partitions and of the rows in them.

    The rows are stored once with their partitions and places, since a second evaluation might deal them out
    differently; the partitions' sizes, one number each, are then summed up.  No row goes to a single task.
    """
    spark = df.sparkSession
    part, place, count, start = _fresh(df, "part", "at", "n", "start")
    path = scratch_path(spark, "rows")
    here = F.spark_partition_id()
    df.withColumn(part, here).withColumn(place, F.monotonically_increasing_id() - F.shiftleft(here.cast("long"), 33)).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy(part).agg(F.count("*").alias(count))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    joined = stored.join(F.broadcast(starts), part)
    return joined.withColumn(ORDINAL, F.col(start) + F.col(place)).drop(part, place, start)


def renumbered(frame: DataFrame) -> DataFrame:
    """frame with its ordinals made contiguous again, in their order."""
    (old,) = _fresh(frame, "old")
    return with_ordinals(frame.withColumnRenamed(ORDINAL, old), [old]).drop(old)


def _fresh(df: DataFrame, *labels: str) -> list[str]:
    """Names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for label in labels:
        while (label := "_" + label).lower() in taken:
            pass
        out.append(label)
    return out


def _row_predicate(function: Callable[[dict, int], bool]):
    @F.arrow_udf("boolean")
    def run(items: pa.Array, ordinals: pa.Array) -> pa.Array:
        return pa.array([bool(function(i, o)) for i, o in zip(items.to_pylist(), ordinals.to_pylist(), strict=True)], pa.bool_())

    return run


def scratch_path(spark: SparkSession, label: str = "index") -> str:
    """A new path below the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillseek-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def is_string_list(df: DataFrame, keys: Sequence) -> bool:
    columns = [f for f in df.schema.fields if f.name != ORDINAL]
    return not keys and len(columns) == 1 and isinstance(columns[0].dataType, T.StringType)


@dataclass(frozen=True)
class Index:
    """frame: ref_index, item, k0, k1, ...  source: the rows it was made from, if it hasn't been stored.  words: term, df, how many
    texts have each word, with the number of texts that have any under the term null; None if they aren't stored.  words_of: the
    options that words were split by."""

    frame: DataFrame
    keys: list[Key]
    strings: bool = False
    field_norm_weight: float = 1.0
    source: DataFrame | None = None
    get: Callable | None = None
    words: DataFrame | None = None
    words_of: tuple | None = None

    @classmethod
    def create(cls, keys: Sequence, docs: DataFrame, get=None, field_norm_weight: float = 1.0) -> Index:
        """docs must have `ref_index`; without keys it must have one more column, of strings."""
        parsed = parse_keys(keys)
        if ORDINAL not in docs.columns:
            raise ValueError(f"docs needs a column {ORDINAL}; with_ordinals() adds it")
        strings = is_string_list(docs, parsed)
        return cls(cls._frame_of(docs, parsed, strings, field_norm_weight, get), parsed, strings, field_norm_weight, docs, get)

    @staticmethod
    def _frame_of(docs: DataFrame, keys: list[Key], strings: bool, field_norm_weight: float, get) -> DataFrame:
        names = [c for c in docs.columns if c != ORDINAL]
        own = keys or ([Key((names[0],))] if strings else [])
        texts = [texts_of(docs, k, field_norm_weight, None if strings else get).alias(f"k{i}") for i, k in enumerate(own)]
        return docs.select(F.col(ORDINAL).cast("long").alias(ORDINAL), F.struct(*[F.col(f"`{c}`") for c in names]).alias("item"), *texts)

    @property
    def width(self) -> int:
        return 1 if self.strings else len(self.keys)

    def plain_columns(self) -> list[Column | None]:
        """For each key the source's column that it searches, where a filter on it can be pushed down to a scan; none for stored indexes."""
        if self.source is None or self.get is not None:
            return [None] * self.width
        own = self.keys or [Key((c,)) for c in self.source.columns if c != ORDINAL]
        return [plain_column(self.source, k) for k in own]

    def where(self, condition: Column) -> Index:
        """The index of the source's rows that satisfy a condition on plain columns."""
        kept = self.source.where(condition)
        return replace(self, frame=self._frame_of(kept, self.keys, self.strings, self.field_norm_weight, None), source=None)

    def records(self) -> DataFrame:
        """The frame without the records that aren't indexed: blank strings."""
        return self.frame.where(F.size("k0") > 0) if self.strings else self.frame

    def fields(self) -> DataFrame:
        """Long form: ref_index, key_idx, key_id, weight, arr_idx, v, n; one row for each text."""
        out = None
        ids = [None] if self.strings else [k.id for k in self.keys]
        for i, key_id in enumerate(ids):
            weight = None if self.strings else self.keys[i].weight
            rows = self.frame.select(ORDINAL, F.explode(f"k{i}").alias("t")).select(
                ORDINAL, F.lit(i).alias("key_idx"), F.lit(key_id).cast("string").alias("key_id"), F.lit(weight).cast("double").alias("weight"),
                F.col("t.i").alias("arr_idx"), F.col("t.v").alias("v"), F.col("t.n").alias("n"),
            )
            out = rows if out is None else out.unionByName(rows)
        return out

    def size(self) -> int:
        return self.records().count()

    def to_json(self) -> str:
        """The keys and the schema of the records."""
        return json.dumps({"keys": json.loads(keys_to_json(self.keys)), "strings": self.strings, "field_norm_weight": self.field_norm_weight, "words_of": self.words_of})

    def save(self, path: str) -> None:
        """Write the records as Parquet and the keys, and the frequencies of words if it has them, beside them."""
        self.frame.write.mode("overwrite").parquet(f"{path}/records")
        if self.words is not None:
            self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.save_keys(path)

    def save_keys(self, path: str) -> None:
        spark = self.frame.sparkSession
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/keys")

    @classmethod
    def load(cls, spark: SparkSession, path: str, get: Callable | None = None, keys: Sequence = ()) -> Index:
        """An index as it was saved; norms are taken as stored.  get, keys: see `parse`."""
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/keys").collect()))
        index = cls.parse(spark.read.parquet(f"{path}/records").drop("batch"), meta, get, keys)
        known = meta.get("words_of")
        return replace(index, words=spark.read.parquet(f"{path}/words"), words_of=tuple(known)) if known else index

    @classmethod
    def parse(cls, frame: DataFrame, meta: dict, get: Callable | None = None, keys: Sequence = ()) -> Index:
        """An index from its records and what `to_json` said.  Functions aren't stored: `get` is the global getter for rows that are
        added, and `keys` has those keys again that were computed; without it `add` raises an error for them."""
        given = {k.id: k.expr for k in parse_keys(keys)}
        own = [Key(k["src"] if isinstance(k["src"], str) else tuple(k["src"]), k["weight"], computed=k.get("computed", False)) for k in meta["keys"]]
        return cls(frame, [replace(k, expr=given.get(k.id)) for k in own], meta["strings"], meta["field_norm_weight"], get=get)

    def persist(self) -> Index:
        return replace(self, frame=self.frame.persist(), source=None)

    def added(self, docs: DataFrame) -> Index:
        """docs' rows as they would be added: after the present ones, in the order of their `ref_index` or else as they are read; docs has
        the records' columns."""
        last = self.frame.agg(F.max(ORDINAL)).first()[0]
        start = -1 if last is None else last
        names = [f.name for f in self.frame.schema["item"].dataType.fields]
        if ORDINAL not in docs.columns:
            docs = numbered_in_place(docs)
        new = docs.select(*[F.col(f"`{c}`") for c in names], (F.col(ORDINAL) + F.lit(start + 1)).alias(ORDINAL))
        return replace(self, frame=self._frame_of(new, self.keys, self.strings, self.field_norm_weight, self.get), source=None, words=None, words_of=None)

    def with_all(self, more: Index) -> Index:
        return replace(self, frame=self.frame.unionByName(more.frame), source=None, words=None, words_of=None)

    def add(self, docs: DataFrame) -> Index:
        return self.with_all(self.added(docs))

    def remove_all(self, ordinals: Sequence[int]) -> Index:
        """Without the records of these ordinals; the others move up.  Ordinals that aren't there are ignored."""
        gone = sorted({int(i) for i in ordinals})
        if not gone:
            return self
        if len(gone) > FEW:
            known = self.frame.sparkSession.createDataFrame([(i,) for i in gone], f"{ORDINAL} long")
            kept = self.frame.join(known, ORDINAL, "left_anti")
            return replace(self, frame=renumbered(kept).select(self.frame.columns), source=None, words=None, words_of=None)
        known = F.array(*[F.lit(i) for i in gone])
        kept = self.frame.where(~F.array_contains(known, F.col(ORDINAL)))
        moved = F.size(F.filter(known, lambda g: g < F.col(ORDINAL)))
        return replace(self, frame=kept.withColumn(ORDINAL, F.col(ORDINAL) - moved), source=None, words=None, words_of=None)

    def remove_at(self, ordinal: int) -> Index:
        self.check_ordinal(ordinal)
        return self.remove_all([ordinal])

    def check_ordinal(self, ordinal) -> None:
        whole = isinstance(ordinal, int) and not isinstance(ordinal, bool) and ordinal >= 0
        if not whole or self.frame.where(F.col(ORDINAL) == F.lit(ordinal)).isEmpty():
            raise errors.SearchError(errors.INVALID_DOC_INDEX)

    def removed(self, predicate: Column | Callable[[dict, int], bool]) -> tuple[DataFrame, DataFrame]:
        """The records that stay and those for which predicate holds: a column on `item` and `ref_index`, or a function of a record, as a
        dict, and its ordinal."""
        if not isinstance(predicate, Column):
            predicate = _row_predicate(predicate)(F.col("item"), F.col(ORDINAL))
        doomed = F.coalesce(predicate, F.lit(False))
        return self.frame.where(~doomed), self.frame.where(doomed)

    def remove_where(self, predicate: Column | Callable[[dict, int], bool]) -> tuple[Index, DataFrame]:
        """Without the records for which predicate holds; and those records' items in order."""
        kept, gone = self.removed(predicate)
        return replace(self, frame=renumbered(kept).select(self.frame.columns), source=None, words=None, words_of=None), gone.orderBy(ORDINAL).select("item.*")

    def value_at(self, ref_index: int, key_id: str):
        """The texts of one record's key, as rows of v, i and n; None for an unknown key."""
        ids = [k.id for k in self.keys]
        if key_id not in ids:
            return None
        at = len(ids) - 1 - ids[::-1].index(key_id)
        row = self.frame.where(F.col(ORDINAL) == ref_index).select(f"k{at}").first()
        return None if row is None else row[0]


def folded(texts: Column, is_case_sensitive: bool) -> Column:
    """The texts of a key as they are compared, but for diacritics."""
    return F.transform(texts, lambda x: x["v"] if is_case_sensitive else F.lower(x["v"]))


