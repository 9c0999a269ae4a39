"""Row numbers and the step that deals numbers to rows."""

from quernel import functions as fn
from quernel.engine import Engine
from quernel.plans.expr import exists, next_value
from quernel.plans.expr import field_ as f
from quernel.plans.statements import select, table_ref, update
from quernel.sources.numbering import consecutive
from quernel.sources.schema import sequence


def values(df):
    return [tuple(r) for r in df.collect()]


def test_row_numbers_of_many_rows(spark):
    """One task would hold all rows if a window numbered them."""
    e = Engine(spark)
    e.sequences.create(sequence("seq", 5))
    e.put("t", spark.range(0, 40, 1, 4).selectExpr("id as k", "id % 4 as g", "cast(null as long) as v"))
    n = fn.any_row_number()
    df = e.query(select(f("k"), n.as_("n"), n.plus(f("k")).as_("s")).from_("t"))
    got = values(df)
    assert sorted(r[0] for r in got) == list(range(40)) and sorted(r[1] for r in got) == list(range(1, 41)) and all(r[2] == r[0] + r[1] for r in got)
    assert df.rdd.getNumPartitions() == 4 and dict(df.dtypes)["n"] == "bigint"
    assert [r[1] for r in values(e.query(select(f("k"), n.as_("n")).from_("t").order_by(f("n").desc()).limit(3)))] == [40, 39, 38]
    grouped = values(e.query(select(f("g"), fn.count().as_("c"), n.as_("n")).from_("t").group_by(f("g"))))
    assert sorted(r[:2] for r in grouped) == [(g, 10) for g in range(4)] and sorted(r[2] for r in grouped) == [1, 2, 3, 4]
    both = values(e.query(select(f("k"), n.as_("n"), n.plus(next_value("seq")).as_("s")).from_("t").order_by(f("k").desc())))
    assert [r[0] for r in both] == list(range(39, -1, -1)) and [r[2] - r[1] for r in both] == list(range(5, 45))
    per_row = exists(select(n.as_("n")).from_(table_ref("t").as_("u")).where(f("k", "u").eq(f("g", "t"))))
    assert e.query(select(f("k")).from_("t").where(per_row)).count() == 40
    e.execute(update("t").set(n.as_("v")).where(f("k").less_than(20)))
    assert sorted(r[2] for r in values(e.table("t")) if r[0] < 20) == list(range(1, 21)) and all(r[2] is None for r in values(e.table("t")) if r[0] >= 20)


def test_numbers_keep_order_and_types(spark):
    x = spark.sql("select timestamp'2023-10-29 01:30:00' as t, date'0001-01-01' as d, timestamp_ntz'1500-03-01 01:02:03' as n, parse_json('[1]') as v, map('k', array(id, null)) as m, id from range(0, 90, 1, 9) where id % 40 < 25")
    same = ["cast(t as long)", "d", "n", "to_json(v)", "to_json(m)", "id"]
    for df in (x, x.sort("id", ascending=False)):
        got = consecutive(df, "number", 7)
        assert got.drop("number").schema == x.schema
        assert values(got.select("number")) == [(k,) for k in range(7, 7 + x.count())]
        assert values(got.selectExpr(*same)) == values(df.selectExpr(*same))
        numbers = got.select("id", "number")
        assert numbers.coalesce(1).union(numbers).distinct().count() == x.count()
