"""Tokens, spreadsheets, schema adapters and the streaming merge."""

import zipfile
from decimal import Decimal

import pytest

from quernel.engine import Engine
from quernel.plans.tokens import tokens
from quernel.sources.datasets import Frames, connect
from quernel.sources.excel import ExcelSink, ExcelSource, read_sheets
from quernel.sources.schema import DataType, altered, augmented, column, decorated, filtered, overridden, schema, table
from quernel.streaming.merge import merge_stream


def test_tokens():
    sql = "SELECT a.\"B\", 'it''s', 1.5e3, :p FROM t -- end\n/* x */ WHERE a <> ? AND b || c >= .5;"
    got = tokens(sql)
    assert "".join(t.text for t in got) == sql
    kinds = {t.text: t.kind for t in got}
    assert [kinds[x] for x in ("SELECT", '"B"', "'it''s'", "1.5e3", ":p", "-- end", "/* x */", "<>", "?", "||", ".5")] == ["IDENTIFIER", "QUOTED_IDENTIFIER", "STRING", "NUMBER", "PARAMETER", "COMMENT", "COMMENT", "OPERATOR", "PARAMETER", "OPERATOR", "NUMBER"]
    with pytest.raises(ValueError, match="no token"):
        tokens("a ~ b")


def test_spreadsheet_round_trip(spark, tmp_path):
    t = table("T").columns(column("a", DataType.INTEGER), column("b", DataType.STRING, 9).nullable(), column("c", DataType.DECIMAL, 9, 2).nullable())
    data = [(1, "x<&> y", Decimal("1.50")), (2, None, None)]
    path = str(tmp_path / "t.xlsx")
    connect(Frames({"T": spark.createDataFrame(data, t.struct)}, schema(t)), ExcelSink(path))
    assert read_sheets(path)["T"][0] == ["T"] and zipfile.is_zipfile(path)
    source = ExcelSource(spark, path)
    source.open()
    assert sorted(map(tuple, source.records("t").collect())) == [("1", "x<&> y", "1.50"), ("2", None, None)]
    connect(Frames({"T": spark.createDataFrame(data, t.struct)}, schema(t)), ExcelSink(path, sample=1))
    assert len(read_sheets(path)["T"]) == 3


def test_adapters():
    t, u = table("T").columns(column("a", DataType.INTEGER), column("b", DataType.INTEGER)), table("U")
    s = schema(t, u)
    assert [x.name for x in filtered(s, ["t"]).tables] == ["T"]
    assert augmented(s, table("t"), table("V")).tables == (t, u, table("V"))
    assert overridden(s, table("U").columns(column("z", DataType.INTEGER))).table("u").has_column("Z")
    assert [x.name for x in decorated(s, "x_").tables] == ["x_T", "x_U"]
    assert [c.name for c in altered(t, ("b", "a")).column_list] == ["b", "a"]


def test_streaming_merge(spark, tmp_path):
    e = Engine(spark, folder=str(tmp_path / "tables"))
    e.put("t", spark.createDataFrame([(1, "old", 0), (9, "kept", 0)], "k int, v string, at int"))
    spark.createDataFrame([(1, "first", 1), (1, "last", 2), (2, "new", 1)], "k int, v string, at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, at int").parquet(str(tmp_path / "in"))
    merge_stream(e, stream, "t", ("k",), "at", str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(map(tuple, e.table("t").collect())) == [(1, "last", 2), (2, "new", 1), (9, "kept", 0)]
    with pytest.raises(ValueError, match="folder"):
        merge_stream(Engine(spark), stream, "t", ("k",), "at", "x")


def test_hints_keep_the_order_and_batches_number_rows(spark):
    from quernel.plans.expr import field_ as f
    from quernel.plans.statements import insert, select
    from quernel.sources.datasets import Merging

    e = Engine.over(spark, "/root/testdata/sf0.001", "nation", "region")
    got = [r.n_name for r in e.query(select(f("n_name")).from_("nation").order_by(f("n_name")).parallel(3)).collect()]
    assert got == sorted(got) and len(got) == 25
    t = table("t").columns(column("k", DataType.BIG_INTEGER).primary_key().auto_numbered(5), column("a", DataType.STRING, 10).nullable())
    e = Engine(spark, schema(t))
    e.put("t", spark.createDataFrame([], t.struct))
    e.execute_batch(insert().into("t"), [{"a": "x"}, {"a": "y"}])
    assert sorted((r.k, r.a) for r in e.table("t").collect()) in ([(5, "x"), (6, "y")], [(5, "y"), (6, "x")])
    with pytest.raises(Exception, match="two input rows"):
        Merging(e).table(t, spark.createDataFrame([(5, "p"), (5, "q")], t.struct))
        e.table("t").collect()
