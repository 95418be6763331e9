"""A quality classifier by importance resampling.

Two generative models over hashed words and word pairs are counted: a target model from documents labelled good and a raw
model from all documents.  A document's importance weight is the ratio of its probabilities under the two: the log of that
ratio is the sum over its features of their log ratios.  It is scaled to a document of 1 / TEMPERATURE features, as long
documents would otherwise outweigh the models' errors by their length.  Adding Gumbel noise, fixed by the id, and keeping the k
largest keys draws k documents without replacement in proportion to their weights (Gumbel top-k).  The raw counts cover
every document; only the labelled rows may be a sample, of about MAX_LABELLED rows chosen by the hash of their ids.

One half of the labelled ids makes the target model.  The other half, which the model hasn't seen, says how many documents to
draw: k is the number of documents whose weight, without noise, reaches the one that separates the held-out documents best
while letting through at least KEEP_GOOD of the good ones.  The k-th key is found by histograms; nothing is sorted.

Defined results: a text without words (null, empty) has no evidence for or against it: weight 0; null ids share
one noise; rows that repeat are scored alike and drawn together, as are rows whose keys tie with the k-th; ids with contradicting labels count as
unlabelled; without good labels every document stays; of a very long text all words count; an empty table gives an empty result;
other columns, whatever their names, pass through `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.llm import _ngrams
from quillseek.llm._shared import SLICE_ROWS, columns_of, fresh, materialise, slices, small_batches

#: Buckets of the models: 2^BITS.
BITS = 16
MAX_LABELLED = 200_000
KEEP_GOOD = 0.998
#: Pseudo-counts, seen and expected, that draw the ratio of a rare bucket towards 1.
SMOOTHING = 4.0
#: Features without evidence that every document is credited with: a few words decide little.
NEUTRAL = 8
#: Log ratios per feature are divided by this before noise is added.
TEMPERATURE = 0.005
SEED = 20_240


def _count_partition(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for part, texts in slices(batches):
            good = np.array([g == 1 and f for g, f in zip(part.column("good").to_pylist(), part.column("fit").to_pylist(), strict=True)])
            buckets, counts = _ngrams.features(texts, bits)
            raw += np.bincount(buckets, minlength=1 << bits)
            if good.any():
                target += np.bincount(buckets[np.repeat(good, counts)], minlength=1 << bits)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    return run


def _weights(texts: list[str], ratios: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each text and its number of features."""
    buckets, counts = _ngrams.features(texts, bits)
    total, some = np.zeros(len(texts)), np.flatnonzero(counts)
    if len(some):
        total[some] = np.add.reduceat(ratios[buckets], np.concatenate([[0], np.cumsum(counts[some])[:-1]]))
    return total / (counts + NEUTRAL), counts


def _score_partition(ratios, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            weight, counts = _weights(texts, ratios.value, bits)
            columns = [part.column("doc_id"), part.column("good"), part.column("fit"), pa.array(weight), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "good", "fit", "weight", "n_features"])

    return run


def labelled(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, good (0 or 1), fit: at most about `most` labelled ids, chosen by hash; contradicting labels are left out.

    fit: whether the id is in the half that makes the model.
    """
    per_id = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("good"))
    per_id = per_id.where("low = good").select("doc_id", F.col("good").cast("int").alias("good"))
    n = per_id.count()
    if n > most:
        per_id = per_id.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return materialise(per_id.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2)) == 0), "labelled")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel variate, fixed by the id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed), F.lit("gumbel")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def log_ratios(docs: DataFrame, bits: int = BITS) -> np.ndarray | None:
    """Log of target over raw probability by bucket; None without target documents.  docs: text, good, fit."""
    counted = docs.select("text", "good", "fit").mapInArrow(_count_partition(bits), "bucket int, raw long, target long")
    # 2^bits rows at most, whatever the input.
    model = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    if not len(model) or not model["target"].sum():
        return None
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[model["bucket"]], target[model["bucket"]] = model["raw"], model["target"]
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def key_of(weight: Column, doc_id: Column) -> Column:
    """The tempered weight with its Gumbel noise."""
    return weight / TEMPERATURE + noise(doc_id)


def score(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """doc_id, good and fit (or null), weight (log ratio per feature), n_features, key for each document; and the log ratios by bucket."""
    sample = labelled(labels)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left")
    with small_batches(docs.sparkSession):
        ratios = log_ratios(known, bits)
        ratios = np.zeros(1 << bits) if ratios is None else ratios
        held = docs.sparkSession.sparkContext.broadcast(ratios)
        schema = "doc_id long, good int, fit boolean, weight double, n_features long"
        scored = known.select("doc_id", "text", "good", "fit").mapInArrow(_score_partition(held, bits), schema)
        return materialise(scored.withColumn("key", key_of(F.col("weight"), F.col("doc_id"))), "scored"), ratios


def boundary(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The weight that separates held-out documents best, with at least keep_good of the good ones at or above it."""
    known = scored.where("NOT fit").select("good", "weight").toPandas()  # bounded by MAX_LABELLED
    good, bad = np.sort(known.loc[known["good"] == 1, "weight"].to_numpy()), np.sort(known.loc[known["good"] != 1, "weight"].to_numpy())
    if not len(good) or not len(bad):
        return -np.inf
    allowed = good[: int((1 - keep_good) * len(good)) + 1]
    lost = np.arange(len(allowed)) / len(good)
    passed = 1 - np.searchsorted(bad, allowed) / len(bad)
    return float(allowed[np.argmin(lost + passed)])


def top_k(scored: DataFrame, k: int, steps: int = 64, fan: int = 256) -> float:
    """The k-th largest key; k is at least 1 and at most the number of rows.  Each pass splits one interval in `fan` cells."""
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    above = 0
    for _ in range(steps):
        width = (high - low) / fan
        if not width or low + width == low:
            break
        inside = scored.where((F.col("key") >= low) & (F.col("key") <= high))
        cell = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(fan - 1))
        cells = {r["c"]: r for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for c in sorted(cells, reverse=True):
            if above + cells[c]["n"] >= k:
                low, high = cells[c]["low"], cells[c]["high"]
                break
            above += cells[c]["n"]
    return low


@dataclass
class Draw:
    """Every document's key, the log ratios of the model, how many documents are drawn and the smallest key that is."""

    scored: DataFrame
    ratios: np.ndarray
    k: int
    lowest: float


def draw(docs: DataFrame, labels: DataFrame) -> Draw:
    """k documents without replacement: those with the k largest keys."""
    scored, ratios = score(docs, labels)
    at = boundary(scored)
    k = scored.where(F.col("weight") >= F.lit(at)).count()
    return Draw(scored, ratios, k, top_k(scored, k) if k else np.inf)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight, n_features, key, kept for each document."""
    drawn = draw(docs, labels)
    return drawn.scored.select("doc_id", "weight", "n_features", "key", (F.col("key") >= F.lit(drawn.lowest)).alias("kept"))


def weight_of(spark: SparkSession, ratios: np.ndarray, bits: int = BITS):
    """A function of texts: their weights, as `score` has them."""
    held = spark.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def weights(texts: pa.Array) -> pa.Array:
        found = []
        for start in range(0, len(texts), SLICE_ROWS):
            found.append(_weights([t or "" for t in texts.slice(start, SLICE_ROWS).to_pylist()], held.value, bits)[0])
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return weights


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are drawn, with all their columns: each row is weighed again where it is read, and none moves."""
    drawn = draw(docs, labels)
    (name,) = fresh(docs, "_weight")
    weighed = docs.withColumn(name, weight_of(docs.sparkSession, drawn.ratios)(F.col("text")))
    return weighed.where(key_of(F.col(name), F.col("doc_id").cast("long")) >= F.lit(drawn.lowest)).select(columns_of(docs))
