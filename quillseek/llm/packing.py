"""Best-fit packing of token sequences with a bounded number of open bins.

Each task encodes its documents, cuts those that are longer than a bin and packs the pieces as they come:
the pieces wait in a short window, which is packed longest first, and a piece goes to the open bin with the least room
that still holds it; if there is none and all bins are in use, the fullest closes.  The open bins are kept in one
integer, a bitset whose bit r says that a bin with r free places is open, so a fit is two bit operations.

The pieces of bins that are still open when a task ends are packed again, together with those of FAN_IN tasks at a time,
by the same algorithm, and so on until one task has seen the last ones.  What a task holds is bounded by FAN_IN,
the number of open bins and the size of a bin.

Defined results: a null text is empty and has only the end id; documents that repeat are packed as often as they
occur; an empty table gives no rows; a document of more than `capacity` ids is cut into pieces of `capacity`, the
first one being the shorter, and of a very long one the text and its ids are held once; an added token's string
in a text is that token; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm._shared import materialise, slices, small_batches
from quillseek.llm._tokens import REMEMBERED, batches, encoder

OPEN_BINS = 4096
FAN_IN = 16
#: Pieces that wait to be packed, longest first; no more than OPEN_BINS, or full bins would close too early.
WINDOW = 4096
#: A bin's id holds, from the top: the round (0: the first pass), the task and a number within it.
LEVEL_BITS, TASK_BITS, SERIAL_BITS = 4, 24, 35
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "open"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, open boolean"


def first_id(level: int, task: int) -> int:
    """The id of the first bin of a task; no two tasks of any rounds share ids."""
    if task >> TASK_BITS or level >> LEVEL_BITS:
        raise ValueError(f"at most {1 << TASK_BITS} tasks and {1 << LEVEL_BITS} rounds")
    return (level << TASK_BITS | task) << SERIAL_BITS


def task_of(bin_id: Column) -> Column:
    return F.shiftright(bin_id, SERIAL_BITS).bitwiseAND((1 << TASK_BITS) - 1)


class BestFit:
    """Bounded-space online best fit over bins of `capacity`; `closed` has the bins that closed since it was last emptied."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.rooms = 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.closed: list[int] = []

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it of an item of 1 to `capacity`."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(room)
        else:
            if self.n_open >= self.open_bins:
                self.closed.append(self._take((self.rooms & -self.rooms).bit_length() - 1))  # the fullest
            room, bin_id = self.capacity, self.next_id
            self.next_id += 1
        left = room - length
        if left:
            self.by_room[left].append(bin_id)
            self.rooms |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(bin_id)
        return bin_id, self.capacity - room

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        bin_id = bins.pop()
        self.n_open -= 1
        if not bins:
            self.rooms &= ~(1 << room)
        return bin_id


class Packer:
    """Packs windows of pieces (rows that begin with doc_id, piece, start, length and crc) and holds those of open bins."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.fit = BestFit(capacity, open_bins, first_id)
        self.held: dict[int, list[tuple]] = {}

    def pack(self, window: list[tuple]) -> list[tuple]:
        """The rows of the bins that close."""
        for row in sorted(window, key=lambda p: -p[3]):
            bin_id, place = self.fit.put(row[3])
            self.held.setdefault(bin_id, []).append((*row[:5], bin_id, place))
        out = [(*row, False) for b in self.fit.closed for row in self.held.pop(b)]
        self.fit.closed.clear()
        return out

    def rest(self) -> list[tuple]:
        return [(*row, True) for rows in self.held.values() for row in rows]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document."""
    first = length % capacity
    out = [(0, first)] if first else []
    return out + [(start, capacity) for start in range(first, length, capacity)]


def _pack_partition(vocabulary: str, end_id: int, capacity: int, open_bins: int, remembered: int = REMEMBERED):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, remembered), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, open_bins, first_id(0, TaskContext.get().partitionId()))
        waiting: list[tuple] = []
        for part, texts in slices(arrow):
            ids = part.column("doc_id").to_pylist()
            for a, b in batches(texts):
                for k, raw in enumerate(enc.encode(texts[a:b]), a):
                    raw += end
                    for n, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        waiting.append((ids[k], n, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                        if len(waiting) >= WINDOW:
                            yield _batch(packer.pack(waiting))
                            waiting = []
        yield _batch(packer.pack(waiting))
        yield _batch(packer.rest())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    kinds = {"piece": pa.int32(), "open": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(COLUMNS, columns, strict=True)], COLUMNS)


def _merge(capacity: int, open_bins: int, level: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        packer = Packer(capacity, open_bins, first_id(level, key[0].as_py()))
        rows = list(zip(*(table.column(n).to_pylist() for n in COLUMNS), strict=True))
        rows.sort(key=lambda r: (-r[3], r[5], r[6]))
        done = packer.pack(rows)
        return pa.Table.from_batches([_batch(done + packer.rest())])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, open_bins: int = OPEN_BINS, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text.  `vocabulary` is the path of a tokenizer file that each executor can read; `remembered`
    bounds the encoder's memory and has no influence on the result.
    """
    with small_batches(docs.sparkSession):
        rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack_partition(vocabulary, end_id, capacity, open_bins, remembered), SCHEMA), "packed")
    done, current = rows.where("NOT open"), rows.where("open").withColumn("task", task_of(F.col("bin")))
    tasks, level = (current.agg(F.max("task")).first()[0] or 0) + 1, 0
    while True:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        merged = current.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task").applyInArrow(_merge(capacity, open_bins, level), SCHEMA)
        merged = materialise(merged, f"merged-{level}")
        if tasks <= 1:
            done = done.unionByName(merged)
            break
        done = done.unionByName(merged.where("NOT open"))
        current = merged.where("open").withColumn("task", task_of(F.col("bin")))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
