"""Replacing a table's rows from a select, and primary keys."""

import pytest

from quernel.engine import Engine
from quernel.operators.evolve import EvolutionError, Recorder
from quernel.plans.expr import field_ as f
from quernel.plans.statements import select
from quernel.sources.schema import DataType, column, schema, table


def _start():
    return schema(table("t").columns(column("a", DataType.BIG_INTEGER).primary_key(), column("b", DataType.BIG_INTEGER)))


def test_replace_table_from(spark):
    e = Engine(spark, _start())
    e.put("t", spark.createDataFrame([(1, 10), (2, 20), (3, 30)], e.schema.table("t").struct))
    r = Recorder(e.schema)
    r.replace_table_from("t", select(f("a"), f("a").as_("b")).from_("t").where(f("b").greater_than(10)))
    r.changes[0].run(e)
    assert sorted(map(tuple, e.table("t").collect())) == [(2, 2), (3, 3)]
    assert r.schema == e.schema
    with pytest.raises(EvolutionError, match="number of fields"):
        r.replace_table_from("t", select(f("a")).from_("t"))


def test_primary_keys():
    r = Recorder(_start())
    r.correct_primary_key("t", ("a", "b"))
    assert r.schema.table("t").primary_key == ("a", "b")
    with pytest.raises(EvolutionError, match="primary key"):
        r.add_primary_key("t", ("b",))
    r.remove_primary_key("t")
    r.add_primary_key("t", ("b",))
    assert r.schema.table("t").primary_key == ("b",)
