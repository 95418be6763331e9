"""Connected components by alternating large and small stars, without collecting anything to one place.

Every task first replaces its edges by a spanning forest (union-find over the edges that it has read), which bounds
what moves by the number of nodes that a task has seen.  Then rounds of the large-star and small-star steps run on
DataFrames; each round ends in a table below the shared folder.  No rounds are needed once so few edges are left that one task's
forest is that of all of them.  Minima are combined in each task before they move,
and neighbours are joined to their minimum with the hubs, of which there is a bounded number, on the side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.llm._shared import forget, join_hot, materialise


#: Edges, at most, of which one task makes the last forest.
LAST_EDGES = 200_000


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, r) for x in list(parent) if (r := find(x)) != x]
    yield pd.DataFrame(out, columns=["a", "b"])


def contract(edges: DataFrame) -> DataFrame:
    """A spanning forest of each task's edges, as pairs of a node and the smallest node of its tree."""
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInPandas(_forest, f"a {kind}, b {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    lowest = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("a", "low"))
    lowest = materialise(lowest, "star-low")
    total = lowest.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(both, lowest, ["a"], "n", total, "inner")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """edges: a, b of one type, any direction, repeats allowed.  Returns node, component (the smallest node of its
    component) for every node that has an edge to another one.  contracted: each task's edges are a forest already."""
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise((ordered if contracted else contract(ordered)).distinct(), "edges")
    for _ in range(max_rounds):
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n:
            break
        if n <= LAST_EDGES:
            return materialise(contract(now.coalesce(1)), "components").select(F.col("a").alias("node"), F.col("b").alias("component"))
        # A forest of stars has no node on both sides.
        large = materialise(_star(now, True), "edges")
        after = materialise(_star(large, False), "edges")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now), forget(large)
        now = after
        if tuple(same) == (n, check):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
