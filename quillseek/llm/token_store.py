"""Token ids in shard files with a minimal perfect hash index.

A shard file holds, one after the other: the raw ids of its documents (unsigned 16 or 32 bit, little endian,
whichever the vocabulary needs), the token offset of each document, the keys in file order, and the index.
The index is a minimal perfect hash function over the distinct keys, built level by level: a key that has a bit of
its level's table to itself is placed there, the others go to the next level, and a key's slot is the number of
set bits before its own.  A slot keeps the first entry with its key, their number and a 32-bit fingerprint of the
key, so that a key which isn't there is told apart (but for one in four billion).  A lookup touches a
constant number of words on average and never scans keys.  A JSON footer with the places of the parts ends the file.

Documents are range-partitioned and sorted by key; each task writes shards of at most SHARD_TOKENS ids (one document
more at most), first under the name of its attempt and then renamed, so that a task that runs again replaces
its files by the same ones.  The driver sees one small row per shard, with its range of keys; `Store` finds a key's shard by
those ranges and opens no other.

Defined results: a null text is empty and has only the end id; null keys come first and can be listed but not
looked up; rows that repeat a key are kept, ordered by a hash of their texts, and found under that key together;
a very long text is one entry of one shard, which it may make larger than the others; an empty table makes no shards and no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.llm._shared import new_path, slices, small_batches
from quillseek.llm._tokens import batches, encoder

MAGIC = b"QSTOKEN1"
SHARD_TOKENS = 16_000_000
#: What a task says about its shards.
MANIFEST = {"partition": pa.int32(), "part": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "first_key": pa.int64(), "last_key": pa.int64()}
#: Shards whose index one store keeps open.
OPEN_SHARDS = 64
MAX_LEVELS = 64
_ONE = np.uint64(1)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes = sizes
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, sizes, words = keys.astype(np.uint64), [], []
        for level in range(MAX_LEVELS):
            if not len(rest):
                break
            size = -(-2 * len(rest) // 64) * 64
            at = (_mix(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("keys must be distinct")
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level has the key's bit."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (_mix(keys[rest], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & _ONE).astype(bool)
            below = np.bitwise_count(word & ((_ONE << bit) - _ONE)).astype(np.int64)
            out[rest[hit]] = (self.ranks[at >> 6] + below)[hit]
            rest, base = rest[~hit], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 1_000_003) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Streams the ids of documents, which come in key order, to one file."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempt: int, id_type: str):
        self.fs, self.path, self.temporary, self.id_type = fs, path, f"{path}.{attempt}", id_type
        self.stream = fs.open_output_stream(self.temporary)
        self.stream.write(MAGIC)
        self.keys: list[int] = []
        self.n_null, self.lengths = 0, []
        self.tokens = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.stream.write(ids.astype(self.id_type).tobytes())
        if key is None:
            self.n_null += 1
        self.keys.append(key or 0)
        self.lengths.append(len(ids))
        self.tokens += len(ids)

    def key_range(self) -> tuple[int | None, int | None]:
        keys = self.keys[self.n_null :]
        return (keys[0], keys[-1]) if keys else (None, None)

    def close(self) -> None:
        at = len(MAGIC) + self.tokens * np.dtype(self.id_type).itemsize
        keys = np.array(self.keys, "<i8")
        distinct, first, count = np.unique(keys[self.n_null :], return_index=True, return_counts=True)
        perfect = PerfectHash.build(distinct.view(np.uint64))
        slots = perfect.slots(distinct.view(np.uint64))
        table = np.zeros(len(distinct), [("first", "<u4"), ("count", "<u4"), ("print", "<u4")])
        table["first"][slots] = first + self.n_null
        table["count"][slots] = count
        table["print"][slots] = fingerprints(distinct.view(np.uint64))
        offsets = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)]).astype("<u8")
        footer = {"id_type": self.id_type, "n_docs": len(keys), "n_null": self.n_null, "n_tokens": self.tokens, "levels": perfect.sizes, "parts": {}}
        for name, part in (("offsets", offsets), ("keys", keys), ("bits", perfect.words), ("slots", table)):
            raw = part.tobytes()
            footer["parts"][name] = [at, len(raw)]
            self.stream.write(raw)
            at += len(raw)
        end = json.dumps(footer).encode()
        self.stream.write(end + struct.pack("<Q", len(end)) + MAGIC)
        self.stream.close()
        self.fs.move(self.temporary, self.path)


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self._read(size - 16, 16))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token shard")
        self.footer = json.loads(self._read(size - 16 - length, length))
        self.id_type = np.dtype(self.footer["id_type"])
        self.offsets = self._part("offsets", "<u8").astype(np.int64)
        self.index = PerfectHash(self.footer["levels"], self._part("bits", "<u8"))
        self.slots = self._part("slots", [("first", "<u4"), ("count", "<u4"), ("print", "<u4")])

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _part(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self._read(*self.footer["parts"][name]), kind)

    def keys(self) -> np.ndarray:
        """All keys in file order; the first n_null ones stand for null."""
        return self._part("keys", "<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry and number of entries of each key; 0 entries for keys that aren't there."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slots = self.index.slots(keys)
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        found = self.slots[np.maximum(slots, 0)]
        there = (slots >= 0) & (found["print"] == fingerprints(keys))
        return found["first"].astype(np.int64), np.where(there, found["count"], 0).astype(np.int64)

    def ids(self, entry: int) -> np.ndarray:
        """The ids of one entry, read from its place in the file."""
        a, b = self.offsets[entry : entry + 2]
        raw = self._read(len(MAGIC) + int(a) * self.id_type.itemsize, int(b - a) * self.id_type.itemsize)
        return np.frombuffer(raw, self.id_type).astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        (first,), (count,) = self.find(np.array([key]))
        return [self.ids(e) for e in range(first, first + count)]


class Store:
    """Keyed access to all shards, from their paths and ranges of keys."""

    def __init__(self, shards: list[tuple[str, int | None, int | None]]):
        known = sorted((first, last, path) for path, first, last in shards if first is not None)
        self.firsts, self.lasts, self.paths = ([row[k] for row in known] for k in range(3))
        self._open: dict[str, Shard] = {}

    @classmethod
    def of(cls, shards: DataFrame) -> Store:
        """From what `write` returned: one row per shard."""
        return cls([tuple(r) for r in shards.select("path", "first_key", "last_key").collect()])

    def shard(self, path: str) -> Shard:
        if path not in self._open:
            while len(self._open) >= OPEN_SHARDS:
                self._open.pop(next(iter(self._open))).file.close()
            self._open[path] = Shard(path)
        return self._open[path]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of all entries with a key; entries with one key may lie in several neighbouring shards."""
        a, b = bisect_left(self.lasts, key), bisect_right(self.firsts, key)
        return [ids for path in self.paths[a:b] for ids in self.shard(path).get(key)]


def _write_partition(vocabulary: str, end_id: int, folder: str, shard_tokens: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get()
        id_type = "<u2" if max(len(enc.byte_length) - 1, end_id) < 1 << 16 else "<u4"
        fs, inner = pafs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        writer, written, k = None, [], 0
        for part, texts in slices(arrow):
            keys = part.column("doc_id").to_pylist()
            for a, b in batches(texts):
                for i, raw in enumerate(enc.encode(texts[a:b]), a):
                    if writer is None:
                        name = f"shard-{task.partitionId():06d}-{k:04d}"
                        writer = ShardWriter(fs, f"{inner}/{name}", task.taskAttemptId(), id_type)
                    writer.add(keys[i], np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
                    if writer.tokens >= shard_tokens:
                        writer.close()
                        written.append((task.partitionId(), k, f"{folder}/{name}", len(writer.keys), writer.tokens, *writer.key_range()))
                        writer, k = None, k + 1
        if writer is not None:
            writer.close()
            written.append((task.partitionId(), k, f"{folder}/{name}", len(writer.keys), writer.tokens, *writer.key_range()))
        columns = list(zip(*written, strict=True)) or [()] * len(MANIFEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, MANIFEST.values(), strict=True)], list(MANIFEST))

    return run


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) as shards below folder; return path, n_docs, n_tokens, start, first_key and last_key of each, in key order."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(partitions, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    schema = "partition int, part int, path string, n_docs long, n_tokens long, first_key long, last_key long"
    with small_batches(spark):
        shards = sorted(sorted_docs.mapInArrow(_write_partition(vocabulary, end_id, folder, shard_tokens), schema).collect(), key=lambda r: r[:2])
    rows, start = [], 0
    for s in shards:
        rows.append((s.path, s.n_docs, s.n_tokens, start, s.first_key, s.last_key))
        start += s.n_tokens
    return spark.createDataFrame(rows, "path string, n_docs long, n_tokens long, start long, first_key long, last_key long")


def _read_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, start in zip(frame["path"], frame["start"], strict=True):
            shard = Shard(path)
            keys, n_null = shard.keys(), shard.footer["n_null"]
            distinct = keys[n_null:][np.insert(np.diff(keys[n_null:]) != 0, 0, True)] if len(keys) > n_null else keys[:0]
            first, count = shard.find(distinct)
            if count.sum() != len(keys) - n_null:
                raise ValueError(f"the index of {path} misses keys")
            entries = [(None, e) for e in range(n_null)]
            entries += [(k, e) for k, f, c in zip(distinct.tolist(), first.tolist(), count.tolist(), strict=True) for e in range(f, f + c)]
            rows = [(k, start + int(shard.offsets[e]), len(ids := shard.ids(e)), zlib.crc32(ids.tobytes())) for k, e in entries]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, each found by its key and read from its shard."""
    n = max(1, min(shards.count(), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return shards.select("path", "start").repartition(n).mapInPandas(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    return read(write(docs, vocabulary, new_path(spark, "tokens"), end_id))
