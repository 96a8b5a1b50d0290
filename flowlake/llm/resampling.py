"""A quality classifier by importance resampling of hashed n-grams.

Words and word pairs fall into `buckets` by hash.  The target model is their frequencies in
documents labelled good (a bounded sample of them), the raw model their frequencies in all
documents, both smoothed by `smooth`.  A document's importance is the ratio of the probabilities
that the two models give to it, so its log is the sum of the log ratios of all its n-grams.
Gumbel noise, a function of doc_id, text and seed, is added, and the `keep` share of documents
with the largest sums is selected: a sample without replacement in proportion to the importances.

Model counts are summed over all documents by bucket, so their size is fixed.  The cut is
found by counts in ever finer bins, never by collecting documents.

Results for odd input: null and empty texts and texts without words have the log weight 0; texts
of any length count with all their n-grams; without good documents all weights are 0 and the
choice is uniform; documents equal in doc_id and text have equal keys and are selected together,
as are other ties at the cut (then there may be more than the share); an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import texts, written
from flowlake.llm.licenses import Folded
from flowlake.llm.windows import U, mixed


def grams(rows: pa.Table, buckets: int) -> tuple[Folded, list[np.ndarray]]:
    """Buckets of the words and word pairs of each document."""
    chunk = Folded(rows)
    word = chunk.words[0]
    one = (word % U(buckets)).astype(np.int64)
    two = (mixed(word[:-1] * U(3) + word[1:]) % U(buckets)).astype(np.int64) if len(word) else one
    cuts = chunk.offsets
    return chunk, [np.concatenate([one[a:b], two[a : max(a, b - 1)]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def lots(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.Table]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield pa.Table.from_batches([whole.slice(at, rows)])


def counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for rows in lots(batches):
            sums += np.bincount(np.concatenate(grams(rows, buckets)[1]), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums)], ["bucket", "n"])

    return run


def frequencies(docs: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket over all documents: one row a bucket reaches the driver."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = np.zeros(buckets)
    for r in rows.mapInArrow(counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def log_ratios(docs: DataFrame, good: DataFrame, buckets: int, target_rows: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the target's and the raw model's probability for each bucket."""
    docs = texts(docs)
    chosen = good.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    raw, target = frequencies(docs, buckets), frequencies(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), buckets)
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smooth) / (target.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_grams, log_weight, key."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lots(batches):
            chunk, found = grams(rows, len(held.value))
            weight = [float(held.value[g].sum()) for g in found]
            noise = rows.column("noise").to_numpy()[chunk.order]
            yield pa.RecordBatch.from_arrays([pa.array(chunk.doc_id, pa.int64()), pa.array([len(g) for g in found], pa.int64()), pa.array(weight, pa.float64()), pa.array(np.array(weight, float) + noise)], ["doc_id", "n_grams", "log_weight", "key"])

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), (-F.log(-F.log(u))).alias("noise"))
    return rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value (k from 1 to the number of rows), by counts in bins that are divided again."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        width = (high - low) / bins
        inside = rows.where(F.col(column).between(low, high))
        if width <= 0 or not math.isfinite(width) or low + width == low:
            return high if above >= k else low
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                n, low, high = counts[b]
                break
            above += counts[b][0]
        if low == high:
            return low
        if n <= few:
            return rows.where(F.col(column).between(low, high)).select(column).orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()[0]


def resample(docs: DataFrame, good: DataFrame, keep: float = 0.8, buckets: int = 10_000, seed: int = 17, target_rows: int = 20_000) -> DataFrame:
    """doc_id, n_grams, log_weight, key, selected.

    good: doc_id of the documents labelled good; the target model is made of up to
    target_rows of them, those with the smallest hashes.
    """
    rows = written(weighed(docs, log_ratios(docs, good, buckets, target_rows), seed), "resampling")
    n = rows.count()
    k = round(keep * n)
    cut = kth_largest(rows, "key", k) if 0 < k <= n else math.inf
    return rows.withColumn("selected", F.col("key") >= F.lit(cut))
