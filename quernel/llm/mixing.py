"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source has a target number of words. Within a source a document's expected number of copies is in
proportion to its weight, the number of binary digits of its size, but at most ``MOST``; the factor is such
that expected words add up to the target. The whole part of that number is taken for certain. The fraction p
that is left is an inclusion probability, which differs from document to document: each document gets a
uniform number u from a digest of its id and text, and documents are ranked by random odds over inclusion
odds, u / (1 - u) over p / (1 - p). The sample has a fixed size, the words that are missing: documents are
taken in that order; one that no longer fits is passed over, until none is left that fits.

The place where the words run out is found from sums over buckets of the order, in two levels, and only rows
of one bucket of the second level are put in order one by one; so no source's rows meet in one task, however
large it is. What follows the first document that doesn't fit is searched in the same way, among those that
still fit, round by round; each round leaves a source with less to fill than the document at its end holds.
Only a row a source (and a size's binary digits) is joined to the documents.

Input cases: null text has size 0 and nothing is taken of it; null source is a source, the last one; null
doc_ids get numbers by their text; rows with equal doc_id and text are drawn together; extra columns, whatever
their names, are kept by ``mix_documents``; empty tables give empty results. Nothing depends on partitioning,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import SPACE, cut, table

#: Sources by code point weigh these in turn.
WEIGHTS = (3, 1, 2)
#: The mix's words as a share of all words.
SHARE = 1.5
#: Times that a document is taken at most.
MOST = 2
BUCKETS = 4096
#: Source rows that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from a digest of key: the first 13 hex digits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def row_uniform(doc_id: Column, text: Column, seed: str = "") -> Column:
    """A document's number: of its id and text (and the seed)."""
    empty = F.lit("")
    return uniform(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), empty), F.lit(" "), F.coalesce(text.cast("string"), empty)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): weights in turn, sources at their limit give their excess to the others.

    Sources are sorted by limit / weight. As long as the words left, shared by the weights left, reach a
    source's limit, it stays at the limit; from the first that is not reached on, words are shared by weight.
    The windows go over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    all_rows = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.max(F.when(F.col("cap") > F.col("w") * F.col("level"), F.col("level"))).over(all_rows))
    return s.select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("free"))).alias("target"))


def expected(base: DataFrame, s: DataFrame, most: int = MOST) -> DataFrame:
    """source, digits, whole, p: what a document of a source is taken for certain and by chance, by its size's binary digits.

    s has source, source_size, target. Copies go up with the digits until they reach ``most``; the windows go
    over a source's few numbers of digits. Those with the most digits reach the limit first: as long as the words
    left, shared by the weights left, would lift one above it, it stays there.
    """
    d = base.where("size > 0").groupBy("source", "digits").agg(F.sum("size").alias("words"))
    d = join_sources(d, s.select("source", "target"))
    by = Window.partitionBy("source").orderBy(F.col("digits").desc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.coalesce(F.sum(F.col("words") * F.lit(float(most))).over(before), F.lit(0.0))
    d = d.withColumn("level", left / F.sum(F.col("words") * F.col("digits")).over(after))
    d = d.withColumn("free", F.max(F.when(F.col("digits") * F.col("level") < most, F.col("level"))).over(Window.partitionBy("source")))
    d = d.withColumn("copies", F.when(F.col("free").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("digits") * F.col("free"))))
    d = d.withColumn("whole", F.floor(F.col("copies") + 1e-9))
    return d.withColumn("p", F.when(F.col("copies") - F.col("whole") < 1e-9, 0.0).otherwise(F.col("copies") - F.col("whole"))).select("source", "digits", "words", "whole", "p")


def _order(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where nothing is drawn."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _border(rows: DataFrame, key: str) -> DataFrame:
    """For each source the first bucket in which the sum of sizes passes ``rest``, as ``at``, and the sum before it, as ``before``."""
    sums = rows.groupBy("sid", key).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    w = Window.partitionBy("sid").orderBy(key)
    sums = sums.withColumn("sum", F.sum("words").over(w)).where("sum > rest")
    return sums.groupBy("sid").agg(F.min(F.struct(F.col(key).alias("at"), (F.col("sum") - F.col("words")).alias("before"))).alias("m")).select("sid", "m.at", "m.before")


def decisions(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, runs) and what ``expected`` gives, both small.

    runs has a struct for each round: documents whose order lies between from and to (without these) and whose
    size is at most ``size`` are drawn.
    """
    s = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    s = cut(s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    # Tables of a row a source are broadcast while they are few, so that a large source's rows needn't meet.
    few = F.broadcast if s.count() <= BROADCAST_SOURCES else lambda t: t
    e = cut(expected(base, s, most))
    r = _with_expected(join_sources(base.where("size > 0"), s.select("source", "sid")), e).where("p > 0").withColumn("x", _order(F.col("u"), F.col("p")))
    y = F.col("x") / (1 + F.col("x")) * BUCKETS
    r = r.withColumn("b1", F.floor(y).cast("int")).withColumn("b2", F.floor((y - F.floor(y)) * BUCKETS).cast("int"))
    r = cut(r.select("sid", "size", "x", "b1", "b2"))
    certain = join_sources(e.groupBy("source").agg(F.sum(F.col("words") * F.col("whole")).alias("certain")), s.select("source", "sid")).select("sid", "certain")
    state = s.join(certain, "sid", "left").select("sid", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("certain", F.lit(0))).alias("rest"), F.lit(-1.0).cast("double").alias("from"))
    state = state.where("rest >= 1")
    rounds = []
    while not state.isEmpty():
        fits = r.join(few(state), "sid").where("x > from and size <= rest").select("sid", "size", "rest", "x", "b1", "b2")
        inner = fits.join(few(_border(fits, "b1")), "sid").where("b1 = at").withColumn("rest", F.col("rest") - F.col("before")).drop("at", "before")
        last = inner.join(few(_border(inner, "b2")), "sid").where("b2 = at").withColumn("rest", F.col("rest") - F.col("before")).drop("at", "before")
        # Equal orders are peers and fall together; the first order that isn't drawn ends the round.
        last = last.withColumn("sum", F.sum("size").over(Window.partitionBy("sid").orderBy("x")))
        ends = last.groupBy("sid").agg(F.min(F.when(F.col("sum") > F.col("rest"), F.col("x"))).alias("to"), (F.first("rest") - F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum")).otherwise(0))).alias("left"))
        run = cut(state.join(ends, "sid", "left").select("sid", "from", "to", F.col("rest").alias("most"), "left"))
        rounds.append(run.drop("left"))
        # Without an end all that fit are drawn, and the source is done.
        state = run.where("to is not null and left >= 1").select("sid", F.col("left").alias("rest"), F.col("to").alias("from"))
    if not rounds:
        return s.withColumn("runs", F.array().cast(_RUNS)).drop("sid"), e
    runs = rounds[0]
    for more in rounds[1:]:
        runs = runs.union(more)
    runs = runs.groupBy("sid").agg(F.collect_list(F.struct("from", "to", F.col("most").alias("size"))).cast(_RUNS).alias("runs"))
    return cut(s.join(runs, "sid", "left").withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS))).drop("sid")), e


_RUNS = "array<struct<from:double,to:double,size:double>>"


def _with_expected(rows: DataFrame, e: DataFrame) -> DataFrame:
    """rows with whole and p by source and digits; rows without words have null there."""
    e = e.select(F.col("source").alias("_source"), F.col("digits").alias("_digits"), "whole", "p")
    small = e.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(e) if small else e, rows["source"].eqNullSafe(e["_source"]) & (rows["digits"] == e["_digits"]), "left").drop("_source", "_digits")


def join_sources(rows: DataFrame, s: DataFrame) -> DataFrame:
    """rows with their source's columns of s; null is a source."""
    s = s.withColumnRenamed("source", "_source")
    small = s.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(s) if small else s, rows["source"].eqNullSafe(s["_source"])).drop("_source")


def _measures(seed: str) -> list[Column]:
    size = n_words(F.col("text"))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), row_uniform(F.col("doc_id"), F.col("text"), seed).alias("u")]


def measured(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, size, digits, u of every document."""
    return docs.select(*_measures(seed)).withColumn("digits", F.length(F.bin("size")))


def copies() -> Column:
    """Times that a row (with its source's runs, whole and p) is taken."""
    x = _order(F.col("u"), F.col("p"))
    drawn = F.exists("runs", lambda r: (x > r["from"]) & (r["to"].isNull() | (x < r["to"])) & (F.col("size") <= r["size"]))
    return F.when(F.col("size") > 0, F.col("whole") + F.when((F.col("p") > 0) & drawn, 1).otherwise(0)).otherwise(0)


def mix_sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    base = cut(measured(docs, seed))
    s, e = decisions(base)
    rows = _with_expected(join_sources(base, s), e).withColumn("copies", copies())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, seed: str = "") -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken (documents without words never)."""
    s, e = decisions(cut(measured(docs, seed)))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *_measures(seed)).withColumn("digits", F.length(F.bin("size")))
    rows = _with_expected(join_sources(keyed, s), e)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


#: The same with windows over whole sources, and documents taken one by one.
ORACLE = r"""
with recursive
base as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
z as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as sid from base group by source),
z1 as (select *, [3.0, 1.0, 2.0][((sid - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as cap from z),
z2 as (select *, (sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over b, 0) as l, sum(w) over () - coalesce(sum(w) over b, 0) as wl from z1
    window b as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)),
z3 as (select *, max(case when cap > w * (l / wl) then l / wl end) over () as free from z2),
z4 as (select sid, source, source_size, case when free is null then cap else least(cap, w * free) end as target from z3),
d0 as (select base.*, sid, source_size, target, length(bin(size)) as digits from base join z4 on base.source is not distinct from z4.source),
e0 as (select sid, digits, any_value(target) as target, sum(size)::double as words from d0 where size > 0 group by sid, digits),
e1 as (select *, (target - coalesce(sum(words * 2.0::double) over (partition by sid order by digits desc rows between unbounded preceding and 1 preceding), 0))
    / sum(words * digits) over (partition by sid order by digits desc rows between current row and unbounded following) as level from e0),
e2 as (select *, max(case when digits * level < 2 then level end) over (partition by sid) as free from e1),
e3 as (select sid, digits, words, case when free is null then 2.0::double else least(2.0::double, digits * free) end as copies from e2),
e as (select sid, digits, words, floor(copies + 1e-9) as whole, case when copies - floor(copies + 1e-9) < 1e-9 then 0 else copies - floor(copies + 1e-9) end as p from e3),
d as (select d0.*, whole, p, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as x from d0 left join e on d0.sid = e.sid and d0.digits = e.digits and d0.size > 0),
r as (select sid, x, any_value(size) as size, sum(size)::double as words from d where p > 0 group by sid, x),
g as (
    select z4.sid, -1.0::double as x, target - coalesce(sum(e.words * e.whole), 0) as rest, true as hit from z4 left join e using (sid) group by z4.sid, target
    union all
    select sid, nx, case when words <= rest then rest - words else rest end, words <= rest from
      (select g.sid, g.rest, min(r.x) as nx, arg_min(r.words, r.x) as words from g join r on r.sid = g.sid and r.x > g.x and r.size <= g.rest group by g.sid, g.rest))
select d.doc_id, d.size, d.source_size, d.target, (d.size * (coalesce(d.whole, 0) + (g.x is not null)::int))::bigint as taken, (coalesce(d.whole, 0) + (g.x is not null)::int)::bigint as copies
from d left join g on g.sid = d.sid and g.x = d.x and g.hit and g.x > 0
"""
