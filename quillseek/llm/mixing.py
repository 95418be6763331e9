"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash of HASH_BITS bits.  A mix takes each document of a source `base` times, and once more if
its hash is below the source's threshold.  Thresholds nest: a smaller budget takes a subset of what a larger one
takes, and reruns agree.

A threshold is found without sorting: one pass sums sizes by source and by the LEVEL_BITS leading bits of the hash;
running sums over those cells give the cell in which the budget ends; only the documents of that boundary cell
are summed again by the next bits, until the cell holds one hash.  The state of a source is a row of a table, so there may be as
many sources as there are hosts; the driver sees sums over all sources.  Sizes are summed in each task before they
move, and rows meet the state of their source by `join_hot`, so a source may hold any share of the rows.

Defined results: a null text has size 0; null is a source of its own and comes last; documents that repeat an id share a
hash and are taken together; documents of size 0 belong to the side of the threshold that their hash is on; a very
long text is counted whole and taken or left as a whole; an empty table gives an empty result; `apply` keeps all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillseek.llm._shared import WORD, columns_of, fresh, join_hot, materialise
from quillseek.sources.index import ORDINAL, with_ordinals

HASH_BITS = 60
LEVEL_BITS = 10
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Sources with more than one in so many rows, fewer than this, are broadcast to the texts that they rule.
RULED_IN_PLACE = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id, or of the text if the id is null."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _targets(sources: DataFrame, budget: float, most: int) -> DataFrame:
    """sources (n, w) with target: shares of budget * sum(n) by weight, none above `most` times its n; the excess goes to the others by weight."""
    total = budget * float(sources.agg(F.sum("n")).first()[0] or 0)
    full, level = F.lit(False), 0.0
    while True:
        # Sources that are full stay so, as the level only rises.
        weight, taken, n = sources.agg(F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, F.col("n") * most)), F.count(F.when(full, 1))).first()
        level = (total - (taken or 0)) / weight if weight else level
        above = F.lit(level) * F.col("w") > F.col("n") * most
        if sources.where(above | full).count() == n:
            return sources.withColumn("target", F.when(full, (F.col("n") * most).cast("double")).otherwise(F.lit(level) * F.col("w")))
        full = above | full


def thresholds(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (s, n, rows, target) with base and threshold.  keys: source, size, h."""
    target, n = F.col("target"), F.col("n")
    base = F.when(n > 0, F.least(F.floor(target / n), F.lit(MOST))).otherwise(0).cast("int")
    state = sources.withColumn("base", base).withColumn("left", target - F.col("base") * n).withColumn("prefix", F.lit(0).cast("long"))
    state = materialise(state.withColumn("threshold", F.when((F.col("left") <= 0) | (n == 0), F.lit(0).cast("long"))), "mix-state")
    used = 0
    while (total := (active := state.where("threshold IS NULL")).agg(F.sum("rows")).first()[0]) is not None:
        shift = HASH_BITS - used - LEVEL_BITS
        here = join_hot(keys, active.select("s", "rows", "prefix", "left"), ["s"], "rows", total, "inner").where(F.shiftright("h", HASH_BITS - used) == F.col("prefix"))
        cells = here.groupBy("s", F.shiftright("h", shift).alias("cell")).agg(
            F.sum("size").alias("own"), F.min("h").alias("low"), F.max("h").alias("high"), F.max("left").alias("budget")
        )
        # At most 2^LEVEL_BITS rows for each source.
        run = Window.partitionBy("s").orderBy("cell")
        ends = cells.withColumn("upto", F.sum("own").over(run)).withColumn("before", F.col("upto") - F.col("own"))
        edge = ends.where("before < budget AND upto >= budget").select("s", "cell", "own", "before", "low", "high")
        used += LEVEL_BITS
        rest = F.col("left") - F.col("before")
        all_fit = F.shiftleft(F.col("prefix") + 1, HASH_BITS - used + LEVEL_BITS)
        # One hash is left: whichever is nearer to the budget.
        one_hash = F.when(F.col("low") == F.col("high"), F.col("low") + F.when(F.col("own") - rest <= rest, 1).otherwise(0))
        found = F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("cell").isNull(), all_fit).otherwise(one_hash)
        kept = ["s", "n", "rows", "target", "base"]
        state = materialise(
            state.join(edge, "s", "left").select(*kept, F.coalesce(rest, "left").alias("left"), F.coalesce("cell", "prefix").alias("prefix"), found.alias("threshold")), "mix-state"
        )
    return state.select("s", "n", "rows", "target", "base", "threshold")


@dataclass
class Mix:
    """keys: s (the source as a key), doc_id, size, h.  plan: s, n, rows, target, base, threshold for each source."""

    keys: DataFrame
    plan: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken."""
        total = self.plan.agg(F.sum("rows")).first()[0] or 0
        copies = F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
        joined = join_hot(self.keys, self.plan, ["s"], "rows", total, "inner")
        return joined.select("doc_id", "size", F.col("n").alias("source_size"), "target", (F.col("size") * copies).cast("long").alias("taken"))


def _key(source: Column) -> Column:
    """A source as a key that isn't null: what follows the first character, or only that for null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> Mix:
    """docs: doc_id, text, source."""
    keys = docs.select(_key(F.col("source")).alias("s"), "doc_id", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    keys = materialise(keys, "mix-keys")
    sums = materialise(keys.groupBy("s").agg(F.sum("size").alias("n"), F.count("*").alias("rows")), "mix-sums")
    placed = with_ordinals(sums, [(F.col("s") == "-"), F.col("s")])
    share = F.array(*[F.lit(w) for w in weights])
    sources = materialise(placed.select("s", "n", "rows", F.get(share, F.pmod(ORDINAL, F.lit(len(weights))).cast("int")).cast("double").alias("w")), "mix-sources")
    return Mix(keys, thresholds(keys, _targets(sources, budget, MOST)))


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them.

    The rules of all but the smallest sources are broadcast; only rows of sources with fewer than one in RULED_IN_PLACE rows move.
    """
    mix = plan(docs, weights, budget)
    s, base, threshold, rows, copy = fresh(docs, "_s", "_base", "_threshold", "_rows", "_copy")
    rule = mix.plan.select(F.col("s").alias(s), F.col("base").alias(base), F.col("threshold").alias(threshold), F.col("rows").alias(rows))
    total = mix.plan.agg(F.sum("rows")).first()[0] or 0
    copies = F.col(base) + F.when(hash_of(F.col("doc_id"), F.col("text")) < F.col(threshold), 1).otherwise(0)
    taken = join_hot(docs.withColumn(s, _key(F.col("source"))), rule, [s], rows, total, "inner", RULED_IN_PLACE).withColumn(copy, copies).where(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(columns_of(docs))
