"""Quality classifier: importance resampling with hashed n-gram models, drawn by Gumbel top-k.

Words and word pairs of lower-cased text are hashed into buckets. Two multinomials over the buckets are
counted: one over trusted documents (a bounded sample of rows labelled as good), one over the whole raw
corpus. A document's log importance weight is the logarithm of the ratio of the two models' probabilities of
its n-grams, the sum of their log ratios. Gumbel noise from a digest of its id is added, and the k documents
with the largest sums stay, k being the labels' share of good rows times the number of documents: sampling
without replacement in proportion to the weights.

Input cases: null text, empty text and text without words have weight 0; very long texts are read whole, in
blocks; repeated rows get equal sums, and of rows at the border those with smaller doc_id stay first, null
doc_ids last (of rows equal in doc_id too, any); without labels all documents stay; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bytehash import chunks, hashes, mix, words
from quernel.llm.common import cut, ship, table
from quernel.llm.mixing import uniform

BUCKETS = 1 << 18
TRUSTED = 20_000
#: Added to a bucket's count in trusted documents and to what it would be at the corpus's rate.
SMOOTHING = 2.0
#: Buckets by which the k-th largest sum is looked for, again and again.
CUTS = 2048


def bags(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first, past last, n-gram buckets, and for each text the index of its first n-gram."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, at = words(data, offsets, True)
        h = hashes(data, starts, ends, True)
        n = np.diff(at)
        # For each word itself and, but for a text's last word, its pair with the next.
        pair = mix(h ^ (np.roll(h, -1) * np.uint64(0x9FB21C651E98DF25))) if len(h) else h
        both = np.stack([h, pair], 1).ravel()
        keep = np.ones(len(both), bool)
        keep[2 * at[1:][n > 0] - 1] = False
        yield first, last, (both[keep] % np.uint64(BUCKETS)).astype(np.int64), 2 * at - np.concatenate([[0], np.cumsum(n > 0)])


def log_ratios(docs: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, float]:
    """Each bucket's log ratio, and the share of good rows among the labels (1 without labels)."""
    flat = np.zeros(BUCKETS)
    if labels is None:
        return flat, 1.0
    share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.0))).first()[0]
    if share is None:
        return flat, 1.0
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left").select("good", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, last, b, at in bags(batch.column(1)):
                raw += np.bincount(b, minlength=BUCKETS)
                good += np.bincount(b[np.repeat(known[first:last], np.diff(at))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["b", "raw", "good"])

    summed = rows.mapInArrow(count, "b long, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    # A row a bucket at most, as three arrays.
    counts = summed.toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["b"].to_numpy()
    raw[at], good[at] = counts["raw"].to_numpy(), counts["good"].to_numpy()
    if not good.sum():
        return flat, 1.0
    return np.log((good + SMOOTHING) / (good.sum() * raw / raw.sum() + SMOOTHING)), float(share)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight of every whole text. Narrow."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, last, b, at in bags(batch.column(1)):
                sums = np.concatenate([[0.0], np.cumsum(sent.value[b])])
                out[first:last] = (sums[at[1:]] - sums[at[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, log_weight double")


def top_k(rows: DataFrame, k: int, by: str) -> DataFrame:
    """rows (as ``cut`` gives them) with ``kept``: whether they are among the k with the largest ``by``, of equal ones those with the least doc_id."""
    n = rows.count()
    if k >= n:
        return rows.withColumn("kept", F.lit(True))
    border, above = kth(rows, k, F.col(by))
    sure = rows.where(F.col(by) > border).withColumn("kept", F.lit(True)).union(rows.where(F.col(by) < border).withColumn("kept", F.lit(False)))
    tied, left = cut(rows.where(F.col(by) == border)), k - above
    # Ties go by doc_id; its negative has the least ones on top, and null ids come last.
    known = tied.where("doc_id is not null")
    n = known.count()
    if left < n:
        border, above = kth(known, left, -F.col("doc_id"))
        inner = known.withColumn("kept", -F.col("doc_id") >= border).union(tied.where("doc_id is null").withColumn("kept", F.lit(False)))
        same, left = cut(known.where(-F.col("doc_id") == border)), left - above
        if left < same.count():
            inner = inner.where((-F.col("doc_id") != border) | F.col("doc_id").isNull()).union(first_rows(same, left))
    else:
        inner = known.withColumn("kept", F.lit(True)).union(first_rows(cut(tied.where("doc_id is null")), left - n))
    return sure.union(inner)


def kth(rows: DataFrame, k: int, by: Column) -> tuple[float, int]:
    """The k-th largest value of ``by``, and how many rows lie above it. Narrowed down by counts over ``CUTS`` buckets of equal width."""
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    above = 0
    while lo < hi:
        # Least and largest values of buckets are values of rows, so that each turn narrows the range down to some of them.
        place = F.least(F.floor((by - lo) / ((hi - lo) / CUTS)), F.lit(CUTS - 1)).cast("int")
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.where(by.between(lo, hi)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                break
            above += counts[b][0]
        if (lo, hi) == counts[b][1:]:  # neighbouring numbers: no bucket parts them
            over = rows.where(by == hi).count()
            return (hi, above) if above + over >= k else (lo, above + over)
        lo, hi = counts[b][1:]
    return lo, above


def first_rows(rows: DataFrame, k: int) -> DataFrame:
    """rows (as ``cut`` gives them) with ``kept`` for k of them, whichever: rows are numbered by partition, with one count a partition."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = rows.withColumn("_part", part).withColumn("_place", place)
    most, left = F.lit(0), k
    for p in sorted(counts):
        if left > 0:
            most = F.when(F.col("_part") == p, min(left, counts[p])).otherwise(most)
            left -= counts[p]
    return numbered.withColumn("kept", F.col("_place") < most).drop("_part", "_place")


def resample(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept for every row of docs."""
    ratios, share = log_ratios(docs, labels)
    u = uniform(F.col("doc_id"))
    rows = cut(weigh(docs, ratios).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    return top_k(rows, math.ceil(share * rows.count()), "gumbel_key")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
