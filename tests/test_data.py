"""Schemas, data sets, XML, comparison and evolution."""

import datetime as dt
from decimal import Decimal

import pytest

from quernel.engine import Engine
from quernel.operators import evolve
from quernel.operators.compare import NON_EMPTY_RESULT, dataset_diff, joined, result_diff, table_diff
from quernel.plans.expr import field_ as f
from quernel.plans.expr import literal
from quernel.plans.statements import select, update
from quernel.sources.datasets import Filtered, Frames, Inserting, Merging, SchemaAdapting, WithMetadata, connect, database_of, masked, table_of
from quernel.sources.schema import DataType, SchemaError, column, differences, id_column, index, schema, sequence, table, validate, version_column, view
from quernel.sources.xml import XmlSink, XmlSource, escape, read_table, unescape

EMPLOYEE = table("employee").columns(column("id", DataType.INTEGER).primary_key(), column("lastName", DataType.STRING, 255).nullable(), column("role", DataType.INTEGER).nullable())


def frames(spark, rows):
    return Frames({"employee": spark.createDataFrame(rows, EMPLOYEE.struct)}, schema(EMPLOYEE))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merging_data_sets(spark):
    e = Engine(spark)
    connect(frames(spark, [(1, "Rogers", 1), (2, "Ferguson", 1)]), Inserting(e))
    connect(frames(spark, [(1, "Willbourne", 3), (4, "Johnson", 4)]), Merging(e), threads=2)
    assert rows(e.table("employee")) == [(1, "Willbourne", 3), (2, "Ferguson", 1), (4, "Johnson", 4)]


def test_schema_adapting(spark):
    e = Engine(spark)
    e.put("old", spark.range(1))
    e.put("employee", spark.range(1))
    connect(frames(spark, [(1, "a", 1)]), SchemaAdapting(e, Inserting(e)))
    assert set(e.frames) == {"employee"} and rows(e.table("employee")) == [(1, "a", 1)]


def test_adapters(spark):
    p = frames(spark, [(1, "a", 1)])
    assert not Filtered(p, ["other"]).schema().tables
    with pytest.raises(KeyError):
        Filtered(p, ["other"]).records("employee")
    t = table("employee").columns(column("ID", DataType.BIG_INTEGER).primary_key())
    assert WithMetadata(p, schema(t)).records("employee").dtypes == [("ID", "bigint")]
    assert rows(masked(p.records("employee"), ["LASTNAME"])) == [(1, None, 1)]
    assert table_of("employee", p.records("employee")) == EMPLOYEE
    assert database_of("jdbc:postgresql://h/d") == "PGSQL"


@pytest.mark.parametrize("name", ["folder", "archive.zip"])
def test_xml_round_trip(spark, tmp_path, name):
    t = table("Test").columns(column("id", DataType.INTEGER).primary_key().auto_numbered(123), column("bar", DataType.STRING, 10).nullable(), column("bob", DataType.DECIMAL, 13, 2).nullable(), column("d", DataType.DATE).nullable(), column("b", DataType.BLOB).nullable(), column("ok", DataType.BOOLEAN).nullable()).indexes(index("fizz").columns("bar", "bob").unique())
    data = [(1, 'a<&"\\', Decimal("1.50"), dt.date(2020, 2, 29), bytearray(b"\0x"), True), (2, None, None, None, None, None), (3, "n\x01\0", None, None, None, False)]
    place = str(tmp_path / name)
    connect(Frames({"Test": spark.createDataFrame(data, t.struct)}, schema(t)), XmlSink(place))
    source = XmlSource(spark, place)
    source.open()
    assert rows(source.records("TEST")) == rows(spark.createDataFrame(data, t.struct))
    assert not differences(schema(t), source.schema())


def test_xml_masks_and_versions(spark, tmp_path):
    connect(frames(spark, [(1, "secret", 1)]), XmlSink(str(tmp_path), masked={"employee": ["lastName"]}))
    assert "secret" not in (tmp_path / "employee.xml").read_text()
    with pytest.raises(ValueError, match="newer"):
        read_table('<table version="5"><metadata name="t"/><data/></table>')
    t, got = read_table('<table version="3"><metadata name="t"><column name="a" type="STRING" width="5" nullable="true"/></metadata><data><record a="x\\y"/><record/></data></table>')
    assert t.name == "T" and got == [("x\\y",), (None,)]
    assert unescape(escape("a\\b\0c\x02")) == "a\\b\0c\x02"
    with pytest.raises(ValueError, match="escape"):
        unescape("\\q")


def test_schema_rules():
    good = table("T").columns(id_column(), version_column(), column("s", DataType.STRING, 3)).indexes(index("T_1").columns("s"))
    validate(schema(good))
    bad = table("select").columns(column("1x", DataType.STRING), column("k", DataType.INTEGER).nullable().primary_key(), column("id", DataType.INTEGER)).indexes(index("a").columns("id"), index("b").columns("k").unique(), index("c").columns("k").unique())
    with pytest.raises(SchemaError) as caught:
        validate(schema(bad))
    for part in ("reserved", "aren't allowed", "needs a width", "nullable in the primary key", "on id alone", "repeats"):
        assert part in str(caught.value)
    assert differences(schema(good), schema(good.columns(*good.column_list[:2]))) == ["column [S] of [T] is only in the first table"]
    assert not differences(schema(good), schema(good, table("tmp_x")), ("TMP_.*",))
    assert schema(good, schema(table("t"))).table("T") is good


LEFT = [("keyA", 20140101, Decimal("10.11")), ("keyB", 20140201, Decimal("10.20")), ("keyC", 20140301, Decimal("10.30"))]
KIND = "k string, d int, v decimal(10,2)"


def diffs(df):
    return sorted(((r.key, r.column_name, r.left_value, r.right_value, r.kind) for r in df.collect()), key=str)


def test_result_diff(spark):
    a = spark.createDataFrame(LEFT, KIND)
    b = spark.createDataFrame([("keyA", 20141101, Decimal("11.1")), ("keyB", 20140201, Decimal("10.2")), ("keyD", 1, None)], KIND)
    got = diffs(result_diff(a, b, keys=(1,)))
    assert len(got) == 6 and set(got) == {("keyA", "d", "20140101", "20141101", "MISMATCH"), ("keyA", "v", "10.11", "11.1", "MISMATCH"), ("keyC", "d", "20140301", None, "MISSING_RIGHT"), ("keyC", "v", "10.3", None, "MISSING_RIGHT"), ("keyD", "d", None, "1", "MISSING_LEFT"), ("keyD", "v", None, None, "MISSING_LEFT")}
    assert not diffs(result_diff(a, a, keys=(1,)))
    for wrong in (lambda: result_diff(a, a), lambda: result_diff(a, a.drop("v"), keys=(1,)), lambda: result_diff(a, a.selectExpr("k", "k as d", "v"), keys=(1,)), lambda: result_diff(a, a.limit(0), (1,), (NON_EMPTY_RESULT,)), lambda: result_diff(a, spark.createDataFrame([(None, 1, None)], KIND), keys=(1,))):
        with pytest.raises(ValueError):
            wrong()


def test_table_and_dataset_diff(spark):
    t = table("t").columns(column("k", DataType.STRING, 9).primary_key(), column("d", DataType.INTEGER), column("v", DataType.DECIMAL, 10, 1).nullable())
    a, b = spark.createDataFrame(LEFT, KIND), spark.createDataFrame([("keyA", 20140101, Decimal("10.12")), *LEFT[1:]], KIND)
    assert not diffs(table_diff(a, b, t))  # equal at the column's scale
    assert len(diffs(table_diff(a, a.where("k <> 'keyB'"), t))) == 2
    keyless = table("t").columns(column("d", DataType.INTEGER))
    assert diffs(table_diff(a.coalesce(1), a.selectExpr("k", "d + 1 as d").coalesce(1), keyless))
    assert dataset_diff(Frames({"t": a}, schema(t)), Frames({"t": a.limit(2), "u": a}, schema(t, table("u")))) == ["table [u] is only in the second data set", "table [t] has 2 differences"]
    assert [r[0] for r in joined(a.limit(1)).collect()] == ["keyA,20140101,10.11"]


BASIC = table("Basic").columns(column("s", DataType.STRING, 20).primary_key(), column("n", DataType.DECIMAL, 10, 0))


def steps():
    extra = column("note", DataType.STRING, 10).nullable()

    def one(r):
        r.add_column("Basic", extra, "none")
        r.execute(update("Basic").set(literal("seen").as_("note")).where(f("s").eq("a")))

    def two(r):
        r.change_column("Basic", BASIC.column("n"), column("amount", DataType.BIG_INTEGER))
        r.add_index("Basic", index("Basic_1").columns("amount"))
        r.rename_index("Basic", "Basic_1", "Basic_2")

    def three(r):
        r.add_table_from(table("Copy").columns(column("k", DataType.STRING, 20)), select(f("s")).from_("Basic"))
        r.rename_table("Copy", "Copied")
        r.add_sequence(sequence("seq", 6))

    target = schema(BASIC.columns(BASIC.column("s"), column("amount", DataType.BIG_INTEGER), extra).indexes(index("Basic_2").columns("amount")), table("Copied").columns(column("k", DataType.STRING, 20)), sequence("seq", 6))
    return target, [evolve.Step("u1", 1, "one", one), evolve.Step("u2", 2, "two", two), evolve.Step("u3", 3, "three", three, reads=("Basic",))]


@pytest.mark.parametrize("graph", [False, True])
def test_upgrade(spark, graph):
    e = Engine(spark, schema(BASIC))
    e.put("Basic", spark.createDataFrame([("a", Decimal(1)), ("b", Decimal(2))], BASIC.struct))
    target, todo = steps()
    up = evolve.Upgrade(e, target, todo, [view("v", select(f("k")).from_("Copied"))])
    assert up.perform(graph) == ["u1", "u2", "u3"]
    assert rows(e.table("Basic").select("s", "amount", "note")) == [("a", 1, "seen"), ("b", 2, "none")]
    assert rows(e.query(select().from_("v"))) == [("a",), ("b",)]
    assert e.sequences.next("SEQ") == 6
    assert set(up.applied()) == {"u1", "u2", "u3"} and up.perform() == []


def test_upgrade_refuses(spark):
    target, todo = steps()
    with pytest.raises(evolve.EvolutionError, match="don't lead to"):
        evolve.find_path(schema(BASIC), target, todo[:1], {})
    with pytest.raises(evolve.EvolutionError, match="same uuid"):
        evolve.pending([todo[0], todo[0]], {})
    with pytest.raises(evolve.EvolutionError, match="another uuid"):
        evolve.pending(todo, {"other": "one"})
    with pytest.raises(evolve.EvolutionError, match="can't become"):
        evolve.ChangeColumn("t", column("a", DataType.STRING, 3), column("a", DataType.INTEGER))
    with pytest.raises(evolve.EvolutionError, match="lose digits"):
        evolve.ChangeColumn("t", column("a", DataType.DECIMAL, 9, 2), column("a", DataType.DECIMAL, 8, 2))
    partner = evolve.Step("u9", 9, "nine", lambda r: None, only_with="u1")
    assert partner in evolve.pending([*todo, partner], {}) and partner not in evolve.pending([*todo, partner], {"u1": "one"})
    assert evolve.graph_edges([(todo[0], [evolve.AnalyseTable("a")]), (todo[1], [evolve.AnalyseTable("b")]), (todo[2], [evolve.AnalyseTable("A")])]) == [set(), set(), {0}]
    with pytest.raises(evolve.EvolutionError, match="repeat"):
        evolve.require_unique(spark.createDataFrame([(1,), (1,)], "a int"), ["a"])


def test_deploy(spark):
    e = Engine(spark)
    target, todo = steps()
    evolve.deploy(e, target, todo)
    assert e.table("Basic").columns == ["s", "amount", "note"] and len(evolve.Upgrade(e, target, todo).applied()) == 3


def test_unopened_tables_are_there(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "Rogers", 1), (2, "Ferguson", 1)], EMPLOYEE.struct).write.parquet(f"{folder}/employee.parquet")
    spark.createDataFrame([("a", Decimal(1)), ("b", Decimal(2))], BASIC.struct).write.parquet(f"{folder}/Basic.parquet")
    e = Engine.over(spark, folder, "employee")
    connect(frames(spark, [(1, "Willbourne", 3), (4, "Johnson", 4)]), Merging(e))
    assert rows(e.table("employee")) == [(1, "Willbourne", 3), (2, "Ferguson", 1), (4, "Johnson", 4)]
    e = Engine.over(spark, folder, "employee", "Basic")
    connect(frames(spark, [(1, "a", 1)]), SchemaAdapting(e, Inserting(e)))
    assert e.has_table("EMPLOYEE") and not e.has_table("Basic")
    target = schema(BASIC.columns(*BASIC.column_list, column("note", DataType.STRING, 10).nullable()))
    step = evolve.Step("u1", 1, "one", lambda r: r.add_column("Basic", column("note", DataType.STRING, 10).nullable(), "none"))
    spark.createDataFrame([("u0", "zero", Decimal(1))], evolve.AUDIT.struct).write.parquet(f"{folder}/UpgradeAudit.parquet")
    e = Engine.over(spark, folder, "Basic", "UpgradeAudit")
    e.schema = schema(BASIC)
    up = evolve.Upgrade(e, target, [step])
    assert up.applied() == {"u0": "zero"} and up.perform() == ["u1"]
    assert rows(e.table("Basic")) == [("a", 1, "none"), ("b", 2, "none")] and set(up.applied()) == {"u0", "u1"}
    spark.createDataFrame([("a", Decimal(1)), ("a", Decimal(2))], BASIC.struct).write.parquet(f"{folder}/Twice.parquet")
    for change in (evolve.ChangeIndex("Twice", None, index("Twice_1").columns("s").unique()), evolve.ChangePrimaryKey("Twice", (), ("s",))):
        with pytest.raises(evolve.EvolutionError, match="repeat"):
            change.run(Engine.over(spark, folder, "Twice"))
