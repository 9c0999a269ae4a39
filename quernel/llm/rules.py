"""Quality rules: counts of words, symbols, repeated lines and windows, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hash buckets of n-grams: one of trusted documents (a bounded sample
of rows labelled as good), one of the whole raw corpus. N-grams are words and pairs of neighbouring words.
``llr_sum`` is the logarithm of how much likelier the text is under the trusted one, ``llr`` the same a n-gram,
so that length doesn't matter; documents whose llr is below a fixed threshold fail. Only DataFrame functions are
used. The weights, one number a bucket, are made by Spark and reach the tasks as the value of a scalar subquery.

Input cases: null and empty text have no words, fail the base rules and score 0; very long texts are read
whole; repeated rows get equal results; without labels no document is trusted, all ratios are 0 and the
base rules decide; extra columns of docs are ignored by ``judge`` and kept by ``keep_good``, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import SPACE, table

#: Hash buckets of the multinomials, a power of two; the weights are this many numbers.
BUCKETS = 1 << 18
#: Trusted documents that are used at most (those whose ids' hashes are least); their ids are broadcast.
TRUSTED = 20_000
#: Documents whose mean log ratio is below this fail.
THRESHOLD = -0.25
#: Added to a bucket's count in trusted documents and to what it would be at the corpus's rate, so that rare buckets say little.
SMOOTHING = 2.0
FEWEST_WORDS = 20
WINDOW = 8


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), F.array().cast("array<string>"))


def chained(hashes: str, apart: int) -> Column:
    """Hashes of each entry together with that ``apart`` places on: from runs of ``apart`` words those of twice as many."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def counted(docs: DataFrame, keep: Column) -> DataFrame:
    """``kept_aside`` (what keep gives), n_words, the counts of the base rules, base_failed, and ngrams, the n-grams' hashes."""
    d = docs.select(keep.alias("kept_aside"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("ws", words(F.col("text")))
    d = d.withColumn("wh", F.transform("ws", lambda w: F.xxhash64(w)))
    d = d.withColumn("pairs", chained("wh", 1)).withColumn("fours", chained("pairs", 2))
    # Where no run of four words is found twice no window is.
    d = d.withColumn("windows", F.when(F.size("fours") > F.size(F.array_distinct("fours")), chained("fours", 4)))
    d = d.withColumn("order", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("same", same_windows("order")).withColumn("hit", repeated_places())
    lines = F.filter("lines", lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.withColumn("lines", F.split("text", "\n", -1)).withColumn("lines", F.when(F.size("lines") > F.size(F.array_distinct("lines")), lines))
    d = d.select(
        "kept_aside",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered("hit"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.concat("wh", "pairs").alias("ngrams"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _window(i: Column) -> Column:
    return F.slice("ws", i + 1, WINDOW)


def same_windows(order: str) -> Column:
    """For each of the windows, ordered by hash, but the first: whether it has the hash of the one before it, and whether it has its words too."""
    neighbours = lambda k: (F.get(order, k)["h"] == F.get(order, k - 1)["h"], _window(F.get(order, k)["i"]) == _window(F.get(order, k - 1)["i"]))
    return F.when(F.col(order).isNotNull(), F.transform(F.sequence(F.lit(1), F.size(order) - 1), lambda k: F.struct(neighbours(k)[0].alias("hash"), (neighbours(k)[0] & neighbours(k)[1]).alias("words"))))


def repeated_places() -> Column:
    """The places of the windows that are found twice or more, in order; null where hashes say that there are none.

    Windows with equal hashes stand together and are compared word by word. If different ones share a hash, all
    windows are ordered by their words instead.
    """
    twice = lambda k: F.coalesce(F.get("same", k - 1)["words"], F.lit(False)) | F.coalesce(F.get("same", k)["words"], F.lit(False))
    plain = F.filter("order", lambda t, k: twice(k))
    by_words = F.array_sort(F.transform("order", lambda t: F.struct(_window(t["i"]).alias("w"), t["i"].alias("i"))))
    at = lambda a, k: F.get(a, k)["w"]
    exact = F.filter(by_words, lambda t, k: F.coalesce(at(by_words, k - 1) == t["w"], F.lit(False)) | F.coalesce(at(by_words, k + 1) == t["w"], F.lit(False)))
    collided = F.exists("same", lambda s: s["hash"] & ~s["words"])
    return F.array_sort(F.when(collided, F.transform(exact, lambda t: t["i"])).otherwise(F.transform(plain, lambda t: t["i"])))


def covered(places: str) -> Column:
    """Words that windows at ordered places cover: each adds what lies beyond the one before it, a window's length at most."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    add = lambda a, i: F.struct((a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total"), i.alias("last"))
    return F.aggregate(places, start, add, lambda a: a["total"])


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """One row: ``weights``, each bucket's log of its share in trusted documents over its share in all. Counts are over all rows of docs."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if labels is None:
        d = d.withColumn("good", F.lit(None).cast("int"))
    else:
        trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
        d = d.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    d = d.select("good", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))
    d = d.withColumn("pairs", chained("wh", 1)).select("good", F.explode(F.concat("wh", "pairs")).alias("h"))
    each = d.select(bucket(F.col("h")).alias("b"), F.lit(1).alias("raw"), "good").union(spark.range(BUCKETS).select(F.col("id").cast("int"), F.lit(0), F.lit(None).cast("int")))
    counts = each.groupBy("b").agg(F.sum("raw").alias("raw"), F.count("good").alias("good"))
    all_ = counts.agg(F.sum("raw").cast("double").alias("n_raw"), F.sum("good").cast("double").alias("n_good"), F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("each"))
    ratio = lambda c: F.log((c["good"] + SMOOTHING) / (F.col("n_good") * c["raw"] / F.col("n_raw") + SMOOTHING))
    return all_.select(F.transform("each", lambda c: F.when(F.col("n_good") > 0, ratio(c)).otherwise(F.lit(0.0))).alias("weights"))


def with_ratio(d: DataFrame, weights: DataFrame) -> DataFrame:
    """d (as ``counted`` gives it) with llr_sum and llr in place of ngrams."""
    # The one mention of weights lets the optimiser put the subquery's value where it is read; it is never a row's value.
    d = d.withColumn("weights", weights.scalar())
    d = d.withColumn("llr_sum", F.aggregate("ngrams", F.lit(0.0), lambda a, h: a + F.get("weights", bucket(h)))).drop("weights")
    return d.withColumn("llr", F.when(F.size("ngrams") > 0, F.col("llr_sum") / F.size("ngrams")).otherwise(F.lit(0.0))).drop("ngrams")


def judge(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns, ``llr`` and ``llr_sum`` for every row of docs."""
    d = with_ratio(counted(docs, F.col("doc_id")), log_ratios(docs, labels))
    kept = (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept")
    return d.select(F.col("kept_aside").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "llr", "llr_sum")


def keep_good(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, columns as they were. Verdicts are computed beside the rows: nothing is joined."""
    d = with_ratio(counted(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), log_ratios(docs, labels))
    # Each row as many times as its verdict says, once or not at all; a filter would be pushed below what it reads.
    times = F.when(~F.col("base_failed") & (F.col("llr") >= threshold), F.array(F.lit(1)))
    return d.select("kept_aside", F.explode(times)).select("kept_aside.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
