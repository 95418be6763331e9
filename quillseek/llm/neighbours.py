"""Embedding near-duplicates by NN-descent.

Equal vectors are one node from the start.  Neighbour lists are seeded from random hyperplanes: nodes with the same
signs in a table share a bucket, and a task compares the nodes of a bucket.  Then the lists are refined: in each
round some nodes are hosts, each host gathers the vectors on its list (neighbours of neighbours meet there) and compares
all of them, and what is nearer than what a list has enters it.  Hosts are the nodes that have the smallest hash of this
round on their own list, so hosts of one cluster hardly overlap.  A list holds the nearest that were found, LIST at first; one
that is saturated, full of links, has twice the room in the next round.

Wherever vectors meet, whether in a bucket, on a host or in two blocks of either, all links among them are seen, and a spanning
forest of them is kept: no more rows than vectors, however dense the group.  So lists and forests are bounded by
the nodes, and the components of the forests are those of all links that were seen.  A vector's links lie within its component;
they are counted, not listed, by comparing the vectors of each component, block by block.

The number of tables follows from the number of signs, so that two vectors at exactly the threshold, which may have no
other neighbour that could lead from one to the other, share a bucket with probability SEEDED at any size.  An audit
then compares a bounded sample of nodes, chosen uniformly, with all nodes; if the recall of their links, averaged
over the nodes that have links, is below TARGET, more tables are seeded and refinement goes on; after MAX_AUDITS failures all
blocks of the table are compared, which takes time in proportion to its square.  Cosines are computed in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
do vectors of different lengths with each other; null ids are kept as rows; repeated rows count as copies of
each other; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillseek.llm._blocks import blocks_of, compare_groups, dealt, sized, spanning
from quillseek.llm._graph import components, contract
from quillseek.llm._shared import join_hot, materialise

THRESHOLD = 0.95
#: Pairs below this cosine don't enter the lists: they can't lead from a vector to one that it links with in one step.
FLOOR = 0.8
#: Tables, at least.
TABLES = 16
#: The probability that a pair at the threshold shares a bucket in some table.
SEEDED = 0.999
#: Nodes in a bucket, about: fewer signs need fewer tables, and tables move vectors.
BUCKET = 128
#: Entries of a list in the first round.
LIST = 16
#: Rounds of refinement after each seeding, at most; audits follow.
MAX_ROUNDS = 4
#: A round that adds a smaller share of links to the lists is the last.
SETTLED = 0.0005
#: Nodes that an audit compares with all nodes.
AUDIT_NODES = 2048
TARGET = 0.995
MAX_AUDITS = 4
#: Rows that are compared at once; groups of more than two blocks are dealt to several.
BLOCK = 1024


def valid(column: str = "embedding"):
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)


def _unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng([7, dim, table]).standard_normal((dim, bits))


def bits_for(count: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(2, count / BUCKET))), 1, 62))


def tables_for(bits: int, threshold: float = THRESHOLD) -> int:
    """So many tables of `bits` signs that vectors at the threshold share a bucket of one with probability SEEDED."""
    same = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(TABLES, int(np.ceil(np.log(1 - SEEDED) / np.log1p(-same)))) if same < 1 else TABLES


def _bucket_partition(tables: range, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                x = _unit(part["embedding"].to_numpy())
                for t in tables:
                    signs = (x @ _planes(dim, t, bits) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield part.assign(cell=[f"{dim}:{t}:{s}" for s in signs.tolist()])[["cell", "nid", "n", "embedding"]]

    return run


def _cell_sizes(tables: range, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _bucket_partition(tables, bits)(frames):
            yield cells.groupby("cell").size().rename("size").reset_index()

    return run


Group = tuple[np.ndarray, np.ndarray, np.ndarray]


def _group_of(rows: pd.DataFrame) -> Group:
    """nid, n and unit vectors."""
    return rows["nid"].to_numpy(), rows["n"].to_numpy(), _unit(rows["embedding"].to_numpy())


def _cosines(left: Group, right: Group) -> Iterator[tuple[int, int, np.ndarray]]:
    """The cosines of two groups, or of a group with itself (left is right), block by block; none of a row with itself."""
    same, x, y = left is right, left[2], right[2]
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            cos = x[i : i + BLOCK] @ y[j : j + BLOCK].T
            if same and i == j:
                np.fill_diagonal(cos, -2.0)
            yield i, j, cos


def _nearest(cos: np.ndarray, floor: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `most` largest entries of each row that reach floor."""
    if cos.shape[1] > most:
        top = np.argpartition(cos, -most, axis=1)[:, -most:]
        a, k = np.nonzero(np.take_along_axis(cos, top, 1) >= floor)
        return a, top[a, k]
    return np.nonzero(cos >= floor)


LISTED = "a long, b long, cos double, link boolean"


def _lists(floor: float, threshold: float, most: int):
    """For each row of a group the `most` nearest (link: false), and a forest of all links of the group (link: true)."""

    def run(left: Group, right: Group) -> Iterator[pd.DataFrame]:
        same = left is right
        n, width = len(left[0]), len(left[0]) if same else len(left[0]) + len(right[0])
        ids = left[0] if same else np.concatenate([left[0], right[0]])
        near = np.zeros((width, width), bool)
        for i, j, cos in _cosines(left, right):
            for rows, columns, values in ((i, j, cos), (j, i, cos.T)):
                a, b = _nearest(values, floor, most)
                if len(a):
                    own, other = (left[0], right[0]) if values is cos else (right[0], left[0])
                    yield pd.DataFrame({"a": own[a + rows], "b": other[b + columns], "cos": values[a, b], "link": False})
                if same and i == j:
                    break
            j += 0 if same else n
            linked = cos >= threshold
            near[i : i + cos.shape[0], j : j + cos.shape[1]] |= linked
            near[j : j + cos.shape[1], i : i + cos.shape[0]] |= linked.T
        a, b = spanning(near)
        if len(a):
            yield pd.DataFrame({"a": ids[a], "b": ids[b], "cos": 1.0, "link": True})

    return run


def _degrees(threshold: float):
    """For each row of a group how many rows, copies counted, it links with."""

    def run(left: Group, right: Group) -> Iterator[pd.DataFrame]:
        same = left is right
        sums = [np.zeros(len(left[0]), np.int64), np.zeros(len(right[0]), np.int64)]
        for i, j, cos in _cosines(left, right):
            near = cos >= threshold
            rows, columns = slice(i, i + near.shape[0]), slice(j, j + near.shape[1])
            sums[0][rows] += near @ right[1][columns]
            if not same or i != j:
                sums[1][columns] += near.T @ left[1][rows]
        total = [sums[0] + sums[1]] if same else sums
        for (ids, *_), links in zip((left, right), total, strict=False):
            yield pd.DataFrame({"nid": ids[links > 0], "links": links[links > 0]})

    return run


def _dealt(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    return dealt(rows, key, ["n", "embedding"], partitions)


def _blocks(size: Column) -> Column:
    return blocks_of(size, 2 * BLOCK)


def _compare_groups(visit: Callable[[Group, Group], Iterator[pd.DataFrame]]):
    return compare_groups(_group_of, visit)


def _seed(nodes: DataFrame, tables: range, bits: int, partitions: int, threshold: float = THRESHOLD) -> DataFrame:
    cells = nodes.mapInPandas(_bucket_partition(tables, bits), f"cell string, nid long, n long, embedding {nodes.schema['embedding'].dataType.simpleString()}")
    sizes = nodes.mapInPandas(_cell_sizes(tables, bits), "cell string, size long").groupBy("cell").agg(F.sum("size").alias("size"))
    large = materialise(sizes.where(F.col("size") > 2 * BLOCK).select("cell", _blocks(F.col("size")).alias("blocks"), "size"), "large-cells")
    cells = cells.withColumn("blocks", F.lit(1).cast("long")) if large.isEmpty() else sized(cells, large, "cell")
    return _dealt(cells, "cell", partitions).mapInPandas(_compare_groups(_lists(FLOOR, threshold, LIST)), LISTED)


def _trimmed(entries: DataFrame, most: int) -> DataFrame:
    """The `most` nearest of each list."""
    distinct = entries.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    near = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return distinct.withColumn("place", F.row_number().over(near)).where(F.col("place") <= most).drop("place")


def _refine(nodes: DataFrame, lists: DataFrame, round_no: int, partitions: int, threshold: float = THRESHOLD) -> DataFrame:
    """What meets on the lists of this round's hosts: their own entries and those whose entry they are."""
    rank = lambda c: F.xxhash64(c, F.lit(round_no))
    most = LIST << round_no
    lowest = lists.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low")).where(rank(F.col("a")) < F.col("low"))
    hosts = lowest.select(F.col("a").alias("host"))
    back = _trimmed(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"), most)
    both = lists.select("a", "b").unionByName(back.select("a", "b")).distinct()
    members = hosts.join(both.withColumnRenamed("a", "host"), "host").select("host", F.col("b").alias("nid")).unionByName(hosts.select("host", F.col("host").alias("nid")))
    # A list and its reverse have at most 2 * most entries.
    members = members.withColumn("blocks", F.lit(max(1, -(-(2 * most + 1) // (2 * BLOCK)))).cast("long"))
    gathered = members.join(nodes, "nid").select("host", "nid", "n", "embedding", "blocks")
    return _dealt(gathered, "host", partitions).mapInPandas(_compare_groups(_lists(FLOOR, threshold, 2 * most)), LISTED)


def _all_blocks(nodes: DataFrame, partitions: int) -> DataFrame:
    sized = nodes.withColumn("dim", F.size("embedding"))
    sizes = sized.groupBy("dim").agg(F.count("*").alias("rows")).select("dim", _blocks(F.col("rows")).alias("blocks"))
    return _dealt(sized.join(F.broadcast(sizes), "dim"), "dim", partitions)


def _links_within(nodes: DataFrame, comp: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """nid, links: how many rows each node links with, by comparing the nodes of each component."""
    members = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "nid")
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", _blocks(F.col("size")))
    sizes = materialise(sizes, "component-sizes")
    rows = sized(nodes.join(members, "nid"), sizes, "component")
    return _dealt(rows, "component", partitions).mapInPandas(_compare_groups(_degrees(threshold)), "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, size: int) -> float:
    """The share of its links that `links` (nid, links) counts, averaged over those of `size` nodes, chosen by hash, that have links."""
    n = nodes.count()
    chosen = nodes.where(F.pmod(F.xxhash64("nid", F.lit("audit")), F.lit(1 << 30)) * F.lit(n) < F.lit(size << 30)).select("nid", "embedding").toPandas()
    if not len(chosen):
        return 1.0
    sample = [(dim, part["nid"].to_numpy(), _unit(part["embedding"].to_numpy())) for dim, part in chosen.groupby(chosen["embedding"].map(len))]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, ids, x in sample:
                part = frame[frame["embedding"].map(len) == dim]
                for i in range(0, len(part), BLOCK):
                    nid, copies, y = _group_of(part[i : i + BLOCK])
                    near = (x @ y.T >= threshold) & (ids[:, None] != nid[None, :])
                    found = near @ copies
                    yield pd.DataFrame({"nid": ids[found > 0], "links": found[found > 0]})

    truth = nodes.mapInPandas(count, "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links")).toPandas()
    if not len(truth):
        return 1.0
    ids = nodes.sparkSession.createDataFrame([(int(i),) for i in truth["nid"]], "nid long")
    have = links.join(F.broadcast(ids), "nid").select("nid", F.col("links").alias("have")).toPandas()
    both = truth.merge(have, "left", "nid").fillna({"have": 0})
    return float((both["have"] / both["links"]).mean())


def _forest_of(entries: DataFrame, before: DataFrame | None) -> DataFrame:
    found = entries.where("link").select("a", "b")
    return materialise(contract(found if before is None else before.unionByName(found)).distinct(), "forest")


def graph(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, float]:
    """nodes: nid, n, embedding (distinct, valid).  node and component of the nodes that link with others, each one's number
    of links, and the audited recall."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = bits_for(nodes.count())
    tables = tables_for(bits, threshold)
    lists = forest = None
    for audit in range(MAX_AUDITS):
        seeded = materialise(_seed(nodes, range(audit * tables, (audit + 1) * tables), bits, partitions, threshold), "seeded")
        forest = _forest_of(seeded, forest)
        entries = seeded.where("NOT link").select("a", "b", "cos")
        lists = materialise(_trimmed(entries if lists is None else lists.unionByName(entries), LIST), "lists")
        have = lists.where(F.col("cos") >= threshold).count()
        for turn in range(MAX_ROUNDS):
            met = materialise(_refine(nodes, lists, turn, partitions, threshold), "met")
            forest = _forest_of(met, forest)
            lists = materialise(_trimmed(lists.unionByName(met.where("NOT link").select("a", "b", "cos")), LIST << turn + 1), "lists")
            before, have = have, lists.where(F.col("cos") >= threshold).count()
            if have - before <= SETTLED * have:
                break
        comp = components(forest)
        links = materialise(_links_within(nodes, comp, partitions, threshold), "links")
        recall = _audit(nodes, links, threshold, AUDIT_NODES)
        if recall >= TARGET:
            return comp, links, recall
    every = _all_blocks(nodes, partitions)
    comp = components(every.mapInPandas(_compare_groups(_lists(2.0, threshold, 1)), LISTED).where("link").select("a", "b"))
    links = every.mapInPandas(_compare_groups(_degrees(threshold)), "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))
    return comp, materialise(links, "links"), 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: vec_id, embedding.  Returns vec_id, n_links, component_id, kept for each row."""
    rows = materialise(vectors.select("vec_id", F.when(valid(), F.col("embedding")).alias("embedding")).withColumn("h", F.xxhash64("embedding")), "vectors")
    whole = rows.where("embedding IS NOT NULL")
    nodes = whole.groupBy("h", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    total = rows.count()
    comp, links, _ = graph(nodes.select("nid", "n", "embedding"), threshold)
    comp = comp.withColumnRenamed("node", "nid")
    known = materialise(nodes.drop("embedding").join(links, "nid", "left").join(comp, "nid", "left").withColumn("component", F.coalesce("component", "nid")), "node-links")
    ids = materialise(known.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "component-ids")
    named = join_hot(known, ids, ["component"], "members", total, "inner")
    of_node = named.select("nid", "h", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    named = materialise(nodes.select("nid", "embedding").join(of_node, "nid").drop("nid"), "named-vectors")
    joined = join_hot(whole, named, ["h", "embedding"], "n", total).select("vec_id", "n_links", "component_id")
    rest = rows.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
