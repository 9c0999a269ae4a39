"""Document fingerprints: exact digests of canonical text, and groups of equal documents.

Canonical text: NFKC, case folded, NFKC again, runs of white space as one space, trimmed. Its fingerprint is
the 128-bit xxh3 digest as hex. Groups are made by digest and then by comparing bytes within a digest's
bucket, so that a collision of digests can't join two documents.

Input cases: null text counts as empty; the empty text has a fingerprint like any other; very long texts
take memory in proportion; repeated rows are members of one group; null doc_ids come last in descending
order; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import cut, ship, table, text_or_empty

#: Digests of buckets with two members or more that go to the tasks at most; beyond, buckets are found by a shuffle join.
BROADCAST_BUCKETS = 200_000

Digest = Callable[[bytes], str]


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def fingerprints(docs: DataFrame, only: set[str] | None = None, digest: Digest = digest) -> DataFrame:
    """doc_id, fingerprint of every row of docs; with ``only``, those whose digest is in it, with ``canonical``, the text. Narrow."""
    ship(docs.sparkSession)
    wanted = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [canonical(t) for t in text_or_empty(batch.column(1).to_pylist())]
            marks = [digest(t.encode()) for t in texts]
            if wanted.value is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])
            else:
                keep = [k for k, m in enumerate(marks) if m in wanted.value]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array([marks[k] for k in keep], pa.string()), pa.array([texts[k] for k in keep], pa.string())], names=["doc_id", "fingerprint", "canonical"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fingerprint string" + ", canonical string" * (only is not None))


def groups_of(docs: DataFrame, marked: DataFrame, digest: Digest = digest) -> tuple[DataFrame, set[str] | None]:
    """Groups of two documents or more, and digests that stand for several texts (null: any may).

    marked has the digests of docs. A bucket of one document is a group of its own and isn't listed. The texts
    of other buckets' members are grouped by digest and bytes, which compares bytes within buckets; Spark
    combines equal texts in each task first, so that a large bucket sends one text a task. Columns: fingerprint,
    variant (the text, where a digest stands for several, else null), first_id, copies.
    """
    shared = cut(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"))
    few = shared.count() <= BROADCAST_BUCKETS
    if few:
        members = fingerprints(docs, {r["fingerprint"] for r in shared.collect()}, digest)
    else:
        members = fingerprints(docs, _All(), digest).join(shared, "fingerprint", "left_semi")
    groups = cut(members.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    collided = groups.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    found = [r["fingerprint"] for r in collided.limit(BROADCAST_BUCKETS + 1).collect()]
    many = len(found) > BROADCAST_BUCKETS
    variant = F.col("canonical") if many else F.when(F.col("fingerprint").isin(found), F.col("canonical")) if found else F.lit(None).cast("string")
    return groups.select("fingerprint", variant.alias("variant"), "first_id", "copies"), None if many else set(found)


class _All(set):
    """Has everything in it."""

    def __contains__(self, x) -> bool:
        return True


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint, variant, ...) with first_id and copies in place of variant."""
    g = groups.select(F.col("fingerprint").alias("_f"), F.col("variant").alias("_v"), "first_id", "copies")
    g = F.broadcast(g) if groups.count() <= BROADCAST_BUCKETS else g
    both = rows.join(g, (rows["fingerprint"] == g["_f"]) & (rows["variant"].isNull() | g["_v"].isNull() | (rows["variant"] == g["_v"])), "left")
    return both.withColumn("first_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))).withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).drop("_f", "_v", "variant")


def copy_groups(docs: DataFrame, digest: Digest = digest) -> DataFrame:
    """doc_id, fingerprint, first_id, copies: first_id is the smallest doc_id whose canonical text has the same bytes, copies their number."""
    return fingerprint_table(docs, digest).select("doc_id", "fingerprint", "first_id", "copies")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, guest, doc_id, text): docs dealt by descending doc_id, sorted within parts; after each part's rows comes, as a guest, the first row of the next part (after the last part: of the first).

    Bounds of the parts are ``parts`` - 1 approximate quantiles, so what reaches the driver doesn't grow with docs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else None
    bounds = sorted(set(found or []), reverse=True)
    part = F.lit(0)
    if bounds:
        # How many bounds lie above a doc_id: first by whole runs of them, then within one run.
        size = max(1, int(len(bounds) ** 0.5))
        runs = [bounds[k : k + size] for k in range(0, len(bounds), size)]
        above = lambda b: b > F.col("doc_id")
        run = F.size(F.filter(F.lit([r[-1] for r in runs]).cast("array<bigint>"), above))
        inner = F.size(F.filter(F.get(F.array(*(F.lit(r).cast("array<bigint>") for r in runs)), run), above))
        part = F.when(F.col("doc_id").isNull() | (run == len(runs)), F.lit(len(bounds))).otherwise(run * size + inner)
    placed = docs.select(part.cast("int").alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    # One row a part: few, and cheap to find, as only ids are read.
    top = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    tops = {r["part"]: r["top"] for r in top.collect()}
    filled = sorted(tops)
    before = {p: filled[k - 1] for k, p in enumerate(filled)}
    wanted = docs.sparkSession.createDataFrame([(p, tops[p], before[p]) for p in filled], "at int, top long, before int")
    heads = placed.join(F.broadcast(wanted), (F.col("part") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = heads.groupBy("before", "top").agg(F.min("text").alias("text")).select(F.col("before").alias("part"), F.lit(1).alias("guest"), F.col("top").alias("doc_id"), "text")
    return placed.union(guests).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, digest: Digest = digest, apart: set[str] | None = frozenset()) -> DataFrame:
    """The contract's table: every text against its edited text and against the next document, each folded once; and
    ``variant``, the canonical text of rows whose digest is in ``apart`` (None: of all)."""
    spark = docs.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held, following):
            key, text, folded, mark = held
            _, after, after_folded, after_mark = following
            k = len(text) // 2
            edited = text[: len(text) - k] + after[:k]
            edited_folded = canonical(edited).encode()
            edited_mark = digest(edited_folded)
            # Equal digests make a bucket; only equal bytes in it are alike.
            variant = folded.decode() if apart is None or mark in apart else None
            return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, float(mark == edited_mark and folded == edited_folded), float(mark == after_mark and folded == after_folded), variant

        def pack(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "variant"])

        held, out = None, []
        for batch in batches:
            for guest, key, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                folded = canonical(text).encode()
                now = (key, text, folded, digest(folded))
                if held is not None:
                    out.append(made(held, now))
                held = None if guest else now
            if out:
                yield pack(out)
                out = []

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, variant string"
    return with_next(docs, parts).mapInArrow(run, schema)


def fingerprint_table(docs: DataFrame, digest: Digest = digest) -> DataFrame:
    """The contract's columns, with each document's group of copies: first_id and copies."""
    rows = cut(compare_edited(docs, digest))
    groups, collided = groups_of(docs, rows, digest)
    # Where a digest stands for several texts, rows come again with the texts that tell them apart.
    return with_groups(rows if collided is not None and not collided else compare_edited(docs, digest, collided), groups)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, with each one's group of copies: first_id and copies besides the contract's columns."""
    return fingerprint_table(table(spark, sf_dir, "documents"))
