"""Comparing all rows of each group of a table, in blocks: a large group is dealt to as many tasks as it has pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm._shared import join_hot


def dealt(rows: DataFrame, key: str, columns: Sequence[str], partitions: int) -> DataFrame:
    """rows: key, nid, blocks and columns.  Every two of a key's blocks, and each with itself, are a group.

    part: 0 in groups of one block, else 1 or 2 for the block that a row is in.
    """
    own, other = F.pmod(F.xxhash64("nid", F.lit("block")), F.col("blocks")), F.col("other")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.concat_ws(":", key, F.least("own", other), F.greatest("own", other))
    part = F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2)
    rows = rows.select(group.alias("group"), part.alias("part"), "nid", *columns)
    return rows.repartition(partitions, "group").sortWithinPartitions("group")


def blocks_of(size: Column, rows: int) -> Column:
    """How many blocks of about `rows` rows."""
    return F.ceil(size / F.lit(rows)).cast("long")


def sized(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """rows with the number of blocks of their key, 1 where sizes (key, size, blocks) doesn't have it."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return join_hot(rows, sizes, [key], "size", total).fillna(1, ["blocks"]).drop("size")


def compare_groups(group_of: Callable[[pd.DataFrame], tuple], visit: Callable[[tuple, tuple], Iterator[pd.DataFrame]]):
    """Rows come sorted by group; all rows of one group are visited."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            group = frame["group"].to_numpy()
            if held and held[0]["group"].iat[0] != group[0]:
                yield from compare(held)
                held = []
            at = 0
            for cut in (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist():
                yield from compare([*held, frame[at:cut]])
                held, at = [], cut
            held.append(frame[at:])
        if held:
            yield from compare(held)

    def compare(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        if len(rows) < 2:
            return
        if not rows["part"].iat[0]:
            own = group_of(rows)
            yield from visit(own, own)
        else:
            left, right = rows[rows["part"] == 1], rows[rows["part"] == 2]
            if len(left) and len(right):
                yield from visit(group_of(left), group_of(right))

    return run


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, breadth-first, of the graph with this symmetric matrix."""
    left = near.any(axis=1)
    parents, children = [], []
    while left.any():
        frontier = np.array([left.argmax()])
        left[frontier] = False
        while len(frontier):
            rows = near[frontier] & left
            found = np.flatnonzero(rows.any(axis=0))
            parents.append(frontier[rows[:, found].argmax(axis=0)])
            children.append(found)
            left[found] = False
            frontier = found
    return np.concatenate(parents or [np.zeros(0, np.int64)]), np.concatenate(children or [np.zeros(0, np.int64)])
