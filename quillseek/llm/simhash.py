"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a grid over the vectors can be range-joined
first and the pairs verified exactly afterwards.  If two fingerprints differ in at most 3 bits, then one of
their halves differs in at most 1, and the 16 counts of that half are equal or differ by one in one place.  So each
distinct fingerprint goes to the cell of each half, and to the 16 cells one step up; pairs meet in the
cell of one of them.  Cells are dealt out by hash and sorted within their partitions; a task verifies the pairs of
one cell at a time and keeps no more than a spanning forest of the links that it has found, so the
output of a dense group is as long as the group.  Components of the forest are the components of all links.

Copies have one fingerprint and are one row from the start.

Three bits of one fingerprint are too few for texts whose similarity is wanted, as the Jaccard coefficient of their
shingles.  `similar` therefore gives each text TABLES fingerprints of its words, weighted by the square roots of their
counts: texts that share most of their shingles share nearly all of their words.  Each table goes through the same grid; pairs
that meet within 3 bits in any table, and differ in no more than MOST_APART of all bits, are candidates.  The candidates' components
are then compared by their shingles, exactly and block by block; a task keeps a spanning forest of what is similar enough.

Defined results: a text without words (null, empty) has fingerprint zero and is linked like any other; a text of
fewer words than a shingle has one shingle, all its words; ties and repeated rows are all returned, each with its
component; the component's id is the smallest non-null id in it; `keep_one` keeps the row of that id and, of rows that
repeat it, one; it keeps rows with a null id and ids whose rows are in several components; a very long text is hashed whole, with
no more than BATCH_CHARS of other texts at once; an empty table gives an empty result; other columns, whatever their names, pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.llm import _ngrams
from quillseek.llm._blocks import blocks_of, compare_groups, dealt, sized, spanning
from quillseek.llm._graph import _forest, components
from quillseek.llm._shared import FILTER_BITS, columns_of, fresh, join_hot, materialise, slices, small_batches, split, without

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Rows of a cell that are compared all at once; larger cells are searched breadth-first.
SMALL_CELL = 64
BATCH_CHARS = 500_000
#: Words of a shingle and similarity of `similar`, its fingerprints, and the largest share of their bits in which candidates differ.
WIDTH = 5
SIMILARITY = 0.8
TABLES = 6
MOST_APART = 0.15
#: Texts that are compared by shingles at once; larger groups are dealt to several tasks.
COMPARED = 512
#: Words or shingles that are taken at once.
CHUNK = 2048


def _shingle_digests(text: str, width: int) -> bytes:
    """The big-endian XXH64 of each shingle, one after the other."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])


def fingerprints_of(texts: list[str], width: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    digests = [_shingle_digests(t, width) for t in texts]
    counts = np.fromiter((len(d) // 8 for d in digests), np.int64, len(digests))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        majority = (2 * ones.astype(np.int64) > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(majority, axis=1).view(">u8").ravel()
    return out


def _fingerprint_partition(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found, start, chars = [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars >= BATCH_CHARS or i + 1 == len(texts):
                    found.append(fingerprints_of(texts[start : i + 1], width))
                    start, chars = i + 1, 0
            prints = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints], ["doc_id", "fp"])

    return run


def fingerprint(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (a signed long with the fingerprint's bits)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(_fingerprint_partition(width), "doc_id long, fp long")


def _cells(distinct: DataFrame) -> DataFrame:
    """fp in the cell of each of its halves (own) and in the cells one step up in one segment."""
    half = "shiftrightunsigned(fp, {}) & 4294967295L"
    counts = "({x} - (shiftright({x}, 1) & 1431655765L))"
    rows = distinct.select("fp", F.posexplode(F.array(F.expr(half.format(0)), F.expr(half.format(32)))).alias("half", "x"))
    rows = rows.select("fp", (F.expr(counts.format(x="x")) + F.col("half") * F.lit(1 << 32)).alias("cell"))
    steps = F.expr(
        "concat(array(struct(cell, true AS own)), transform(filter(sequence(0, 15), i -> shiftright(cell, 2 * i) & 3L < 2),"
        " i -> struct(cell + shiftleft(1L, 2 * i) AS cell, false AS own)))"
    )
    return rows.select("fp", F.explode(steps).alias("c")).select("c.cell", "c.own", "fp")


def _links(frames: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Pairs of fingerprints within max_bits that meet in a cell; rows come sorted by cell, own ones first."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame["cell"].iat[-1]
        if frame["cell"].iat[0] != last or (held and held[0]["cell"].iat[0] != last):
            whole = frame["cell"].searchsorted(last)
            yield from _cell_links(pd.concat([*held, frame[:whole]]), max_bits)
            held = [frame[whole:]]
        else:
            held.append(frame)
    if held:
        yield from _cell_links(pd.concat(held), max_bits)


def _cell_links(rows: pd.DataFrame, max_bits: int) -> Iterator[pd.DataFrame]:
    """a and b are ids where rows have them, and else the fingerprints; dense: whether a pair is part of a forest of its cell."""
    cell, own, fp = rows["cell"].to_numpy(), rows["own"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
    ids = rows["nid"].to_numpy() if "nid" in rows else fp.view(np.int64)
    if not len(cell):
        return
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    # The rows that still have a row `shift` places on in their cell; only own rows begin a pair.
    left = np.repeat(starts + sizes, sizes)
    big = np.repeat(sizes > SMALL_CELL, sizes)
    at = np.flatnonzero(own & ~big)
    shift = 1
    while len(at := at[at + shift < left[at]]):
        near = np.bitwise_count(fp[at] ^ fp[at + shift]) <= max_bits
        if near.any():
            yield pd.DataFrame({"a": ids[at[near]], "b": ids[at[near] + shift], "dense": False})
        shift += 1
    for k in np.flatnonzero(sizes > SMALL_CELL):
        s = slice(starts[k], starts[k] + sizes[k])
        if own[s].any():
            distinct, first, inverse = np.unique(fp[s], return_index=True, return_inverse=True)
            a, b = _search(distinct, max_bits)
            chosen = ids[s][first]
            a, b = np.concatenate([chosen[a], chosen[inverse]]), np.concatenate([chosen[b], ids[s]])
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b], "dense": True})


def _search(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, breadth-first, as places."""
    a, b, queue, rest = [], [], [], np.arange(len(prints))
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(prints[rest] ^ prints[x]) <= max_bits
        if near.any():
            found = rest[near]
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found)
            rest = rest[~near]
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """distinct: fp.  Spanning forests (a, b) whose components are those of all links; up to 3 differing bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the grid finds links of at most {MAX_BITS} bits")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _cells(distinct).repartition(n, "cell").sortWithinPartitions("cell", F.desc("own"))
    return cells.mapInPandas(lambda frames: _forest(_links(frames, max_bits)), "a long, b long")


def word_fingerprints(texts: list[str], tables: int = TABLES) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the words of each text, weighted by the square roots of their counts: (texts, tables)."""
    words, counts = _ngrams.words(texts)
    known, place = np.unique(words, return_inverse=True)
    # Whole weights, so that sums are exact in any order.
    pairs, times = np.unique(place * len(texts) + np.repeat(np.arange(len(texts)), counts), return_counts=True)
    weights = np.round(np.sqrt(times) * 16).astype(np.float32)
    sums = np.zeros((len(texts), 64 * tables), np.float32)
    for first in range(0, len(known), CHUNK):
        some = known[first : first + CHUNK]
        a, b = np.searchsorted(pairs, [first * len(texts), (first + len(some)) * len(texts)])
        of_text = np.zeros((len(texts), len(some)), np.float32)
        of_text[pairs[a:b] % len(texts), pairs[a:b] // len(texts) - first] = weights[a:b]
        with np.errstate(over="ignore"):
            bits = np.stack([_ngrams.mix(some + np.uint64(SEED + 1 + t) * np.uint64(0x9E3779B97F4A7C15)) for t in range(tables)], axis=1)
        signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
        signs *= 2
        signs -= 1
        sums += of_text @ signs
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64)


def _word_print_partition(tables: int):
    names = [f"p{t}" for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            prints = word_fingerprints(texts, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "h1", "h2"]).columns, *(pa.array(prints[:, t]) for t in range(tables))], ["doc_id", "h1", "h2", *names])

    return run


def _cells_of(batch: pa.RecordBatch, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a batch, (rows, tables), and the cells of their halves, (rows, tables, 2)."""
    prints = np.stack([batch.column(f"p{t}").to_numpy().view(np.uint64) for t in range(tables)], axis=1)
    halves = np.stack([prints & np.uint64(0xFFFFFFFF), prints >> np.uint64(32)], axis=2)
    counts = halves - (halves >> np.uint64(1) & np.uint64(0x55555555))
    return prints, counts + (np.arange(2 * tables, dtype=np.uint64) << np.uint64(32)).reshape(tables, 2)


def _place_in_filter(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a cell is in and its bit."""
    h = _ngrams.mix(cells)
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


def _own_cell_words(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, np.uint64)
        for batch in batches:
            if batch.num_rows:
                np.bitwise_or.at(bits, *_place_in_filter(np.unique(_cells_of(batch, tables)[1])))
        words = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits[words].view(np.int64))], ["word", "bits"])

    return run


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of a partition as one row of two byte strings: the driver would take a million rows as as many Python objects."""
    held = [(batch.column("word").to_numpy(), batch.column("bits").to_numpy()) for batch in batches if batch.num_rows]
    if held:
        words, bits = (np.concatenate(v).tobytes() for v in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.binary()), pa.array([bits], pa.binary())], ["words", "bits"])


def _occupied(nodes: DataFrame, tables: int) -> np.ndarray:
    """The filter of all rows' own cells, 2^FILTER_BITS words."""
    words = nodes.mapInArrow(_own_cell_words(tables), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    occupied = np.zeros(1 << FILTER_BITS, np.uint64)
    for row in words.mapInArrow(_packed_words, "words binary, bits binary").collect():
        occupied[np.frombuffer(row["words"], np.int32)] = np.frombuffer(row["bits"], np.uint64)
    return occupied


def _occupied_cells(tables: int, occupied):
    """Rows of `_cells`, without those of cells that the filter says aren't any row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = occupied.value
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, cells = _cells_of(batch, tables)
            ids, fps = (np.broadcast_to(v[:, :, None], cells.shape) for v in (np.broadcast_to(batch.column("nid").to_numpy()[:, None], prints.shape), prints))
            out = [(cells.ravel(), ids.ravel(), fps.ravel(), True)]
            for i in range(16):
                up = (cells >> np.uint64(2 * i) & np.uint64(3)) < 2
                step = cells[up] + (np.uint64(1) << np.uint64(2 * i))
                word, bit = _place_in_filter(step)
                known = (filled[word] & bit) != 0
                out.append((step[known], ids[up][known], fps[up][known], False))
            own = np.concatenate([np.full(len(c), o) for c, _, _, o in out])
            cell, nid, fp = (np.concatenate([row[k] for row in out]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(own), pa.array(fp.view(np.int64)), pa.array(nid)], ["cell", "own", "fp", "nid"])

    return run


def candidates(nodes: DataFrame, tables: int = TABLES, max_bits: int = MAX_BITS, most_apart: float = MOST_APART) -> DataFrame:
    """nodes: nid, p0, p1, ...  Pairs (a, b) of which the components hold all pairs within max_bits in some table and most_apart of all bits."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt_nodes = nodes.select("nid", *[f"p{t}" for t in range(tables)]).repartition(n)
    # A cell one step up matters only if it is some row's own: a filter of fixed size holds back nearly all others.
    occupied = spark.sparkContext.broadcast(_occupied(dealt_nodes, tables))
    cells = dealt_nodes.mapInArrow(_occupied_cells(tables, occupied), "cell long, own boolean, fp long, nid long")
    cells = cells.repartition(n, "cell").sortWithinPartitions("cell", F.desc("own"))
    met = cells.mapInPandas(lambda frames: _links(frames, max_bits), "a long, b long, dense boolean")
    met = materialise(met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("dense").alias("dense")), "met")
    prints = [f"p{t}" for t in range(tables)]
    loose = met.where("NOT dense")
    for side, mark in (("a", "x"), ("b", "y")):
        loose = loose.join(nodes.select(F.col("nid").alias(side), *[F.col(p).alias(mark + p) for p in prints]), side)
    apart = sum((F.bit_count(F.col("x" + p).bitwiseXOR(F.col("y" + p))) for p in prints), F.lit(0))
    return met.where("dense").select("a", "b").unionByName(loose.where(apart <= int(most_apart * 64 * tables)).select("a", "b"))


def _shingles(width: int):
    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        digests = [_shingle_digests(t or "", width) for t in texts.to_pylist()]
        # Texts without words share one.
        return pa.array([np.unique(np.frombuffer(d, ">i8").astype(np.int64)) if d else np.zeros(1, np.int64) for d in digests], pa.list_(pa.int64()))

    return run


def _shingled(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    return rows["nid"].to_numpy(), [np.asarray(s) for s in rows["shingles"]]


def _alike(similarity: float):
    """A forest of the pairs of a group whose shingles have this Jaccard coefficient or more."""

    def run(left: tuple, right: tuple) -> Iterator[pd.DataFrame]:
        ids, sets = (left if left is right else (np.concatenate([left[0], right[0]]), left[1] + right[1]))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), sizes)
        known, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one text alone are in no intersection.
        several = times > 1
        inside = several[column]
        owner, column, known = owner[inside], (np.cumsum(several) - 1)[column[inside]], known[several]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(sets), len(sets)))
        for first in range(0, len(known), CHUNK):
            a, b = np.searchsorted(column, [first, first + CHUNK])
            has = np.zeros((len(sets), min(CHUNK, len(known) - first)), np.float32)
            has[owner[a:b], column[a:b] - first] = 1
            shared += has @ has.T
        near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(near, False)
        a, b = spanning(near)
        yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return run


def similar(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, tables: int = TABLES) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable over pairs of that Jaccard similarity of their shingles)."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    schema = "doc_id long, h1 long, h2 long, " + ", ".join(f"p{t} long" for t in range(tables))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(docs.sparkSession):
        prints = materialise(hashed.mapInArrow(_word_print_partition(tables), schema), "word-prints")
        own = [F.min(f"p{t}").alias(f"p{t}") for t in range(tables)]
        nodes = prints.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), *own)
        nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "word-nodes")
        total = nodes.agg(F.sum("n")).first()[0] or 0
        groups = components(candidates(nodes, tables))
        members = materialise(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "nid"), "candidates")
        sizes = members.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", blocks_of(F.col("size"), COMPARED))
        of_text = nodes.select("nid", "h1", "h2").join(members, "nid")
        maybe, _ = split(hashed.select("h1", "h2", "text"), F.col("h1"), of_text, F.col("h1"))
        shingled = maybe.groupBy("h1", "h2").agg(F.first("text").alias("text")).select("h1", "h2", _shingles(width)(F.col("text")).alias("shingles"))
        rows = sized(of_text.join(shingled, ["h1", "h2"]).drop("h1", "h2"), materialise(sizes, "candidate-sizes"), "component")
        alike = dealt(rows, "component", ["shingles"], partitions).mapInPandas(compare_groups(_shingled, _alike(similarity)), "a long, b long")
        alike = materialise(alike, "alike")
    comp = components(alike).withColumnRenamed("node", "nid")
    linked = nodes.select("nid", "h1", "h2", "n", "first_id").join(comp, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    linked = materialise(linked, "linked-texts")
    ids = materialise(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("texts")), "text-components")
    named = join_hot(linked, ids, ["component"], "texts", total, "inner").select("h1", "h2", "n", "component_id")
    return join_hot(prints.select("doc_id", "h1", "h2"), materialise(named, "named-texts"), ["h1", "h2"], "n", total).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, group_size."""
    with small_batches(docs.sparkSession):
        prints = materialise(fingerprint(docs, width), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "distinct-prints")
    total = prints.count()
    comp = components(links(distinct.select("fp"), max_bits), contracted=True)
    linked = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = materialise(linked, "linked-prints")
    ids = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("prints"))
    several = materialise(ids.where("prints > 1"), "several-prints")
    inside = several.agg(F.sum("prints")).first()[0] or 0
    named = join_hot(linked, several, ["component"], "prints", inside).select(
        "fp", "n", F.when(F.col("group_size").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("group_size", "n").alias("group_size")
    )
    named = materialise(named, "named-prints")
    return join_hot(prints, named, ["fp"], "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def keep_one(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component of fingerprints, with all its columns."""
    return _one_of_each(docs, near_duplicates(docs, width, max_bits))


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One document of each component of similar texts, with all its columns."""
    return _one_of_each(docs, similar(docs, similarity, width))


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    ids = materialise(
        found.groupBy("doc_id").agg(F.max(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"), F.count("*").alias("rows"), F.count_distinct("component_id").alias("kinds")),
        "near-ids",
    )
    own_id = F.col("doc_id").cast("long")
    gone = ids.where("gone AND kinds < 2 AND doc_id IS NOT NULL").select("doc_id")
    kept = without(docs, gone, {"doc_id": own_id})
    odd = ids.where("NOT gone AND rows > 1 AND doc_id IS NOT NULL").select("doc_id")
    if odd.isEmpty():
        return kept
    known, row = fresh(docs, "_known", "_one")
    probe = F.xxhash64(own_id)
    maybe, _ = split(kept, probe, odd, F.xxhash64("doc_id"))
    once = maybe.join(odd.select(F.col("doc_id").alias(known)), own_id == F.col(known))
    once = once.groupBy(known).agg(F.first(F.struct(columns_of(docs))).alias(row)).select(F.col(f"{row}.*"))
    return without(kept, odd, {"doc_id": own_id}).unionByName(once)
