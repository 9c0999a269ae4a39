"""Lowering of selects to DataFrames: Catalyst gets one declarative plan and chooses how to run it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.expr import ROW_NUMBER, DslError, Expr, Ref, Scope, contains_aggregate, drawn, postponed
from quernel.plans.statements import Select, TableRef
from quernel.sources.numbering import consecutive

#: Hints of the DSL that mean something to Spark; all others change nothing.
_SPARK_HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl", "rebalance", "coalesce", "repartition")


class Lowering:
    def __init__(self, spark: SparkSession, resolve: Callable[[TableRef], DataFrame], parameters: dict[str, Any] | None = None, sequences=None):
        self.spark, self.resolve, self.parameters, self.sequences = spark, resolve, parameters or {}, sequences

    def scope(self, tables: dict[str, set[str]], outer: Scope | None = None) -> Scope:
        return Scope(tables, outer, self.parameters, self._inner, self.sequences)

    def dealt(self, df: DataFrame, names: list[str], hidden: str = "__n") -> tuple[DataFrame, dict[str, Column]]:
        """df with a hidden column, and by it row numbers and each sequence's next values: a block of one number a row is reserved.

        Rows of a subselect that refers outside can't be numbered here: Spark does that for each row outside.
        """
        if not names or names == [ROW_NUMBER] and df._jdf.queryExecution().isLazyAnalysis():
            return df, {}
        n = df.count() if names != [ROW_NUMBER] else 0
        firsts = {x: 1 if x == ROW_NUMBER else self.sequences.reserve(x, n) for x in names}
        return consecutive(df, hidden, 0), {x: F.col(hidden) + F.lit(k).cast("bigint") for x, k in firsts.items()}

    def _inner(self, s: Select, outer: Scope) -> DataFrame:
        if s.hints:
            raise DslError("a subselect can't have hints")
        return self.select(s, outer)

    def _source(self, source, tables: dict[str, set[str]], outer: Scope | None) -> DataFrame:
        if isinstance(source, Select):
            df, name = self._inner(source, outer), source.alias or f"s{len(tables)}"
        else:
            df, name = self.resolve(source), source.alias or source.name
        if name.lower() in tables:
            raise DslError(f"alias {name} is used twice")
        tables[name.lower()] = {c.lower() for c in df.columns}
        return df.alias(name)

    def select(self, s: Select, outer: Scope | None = None) -> DataFrame:
        """Clauses in the order that the text would have: sources, joins, where, groups, having, unions, excepts, order, limit."""
        tables: dict[str, set[str]] = {}
        frames = [self._source(x, tables, outer) for x in s.sources]
        df = reduce(DataFrame.crossJoin, frames) if frames else self.spark.range(1).select()
        for j in s.joins:
            right = self._source(j.source, tables, outer)
            df = df.crossJoin(right) if j.kind == "cross" else df.join(right, j.on.lower(self.scope(tables, outer)), j.kind)
        scope = self.scope(tables, outer)
        if s.criterion is not None:
            df = df.filter(s.criterion.lower(scope))
        simple = not s.set_ops and not s.is_distinct
        df = self._project(s, df, scope, s.orders if simple else (), s.row_limit if simple else None)
        if s.is_distinct:
            df = df.distinct()
        for kind in ("union", "except"):
            for op in s.set_ops:
                if op.kind.startswith(kind):
                    other = self.select(op.select, outer)
                    df = df.union(other) if op.kind == "union_all" else df.union(other).distinct() if kind == "union" else df.subtract(other)
        if s.orders and not simple:
            named = self.scope({"": {c.lower() for c in df.columns}}, outer)
            df = df.orderBy(*(o.apply(_plain(o.expr).lower(named)) for o in s.orders))
        if s.row_limit is not None:
            df = df.limit(s.row_limit)
        return self._hinted(df, s)

    def _project(self, s: Select, df: DataFrame, scope: Scope, orders, limit: int | None) -> DataFrame:
        """The select list, with grouping, HAVING and the order; conditions and orders go along as hidden columns.

        Row numbers are dealt before the order, next values last, to the rows that are left, in their order.
        """
        grouped = bool(s.groups) or s.having_ is not None or any(contains_aggregate(f) for f in s.fields_)
        if not s.fields_ and not grouped:
            return df.orderBy(*(o.lower(scope) for o in orders)) if orders else df
        names = [f.implied_name or f"_{k}" for k, f in enumerate(s.fields_)]
        given = {n.lower(): f for n, f in zip(names, s.fields_, strict=True)}
        keys = []
        for o in orders:
            e = o.expr
            if isinstance(e, Ref) and not e.table and e.name.lower() in given and not any(e.name.lower() in c for c in scope.tables.values()):
                e = given[e.name.lower()]  # an alias of the select list
            keys.append(e)
        early: list[Expr] = []
        late = {k: postponed(f, early) for k, f in enumerate(s.fields_) if drawn(f)}
        by_number = {k: postponed(e, early) for k, e in enumerate(keys) if ROW_NUMBER in drawn(e)}
        sequences = [x for x in drawn(*late.values()) if x != ROW_NUMBER]
        if sequences and self.sequences is None:
            raise DslError("no sequences here")
        columns = [F.lit(None).cast("bigint").alias(f"__f{k}") if k in late else f.lower(scope).alias(f"__f{k}") for k, f in enumerate(s.fields_)]
        columns += [f.lower(scope).alias(f"__a{k}") for k, f in enumerate(early)]
        columns += [e.lower(scope).alias(f"__o{k}") for k, e in enumerate(keys) if k not in by_number]
        if s.having_ is not None:
            columns.append(s.having_.lower(scope).alias("__h"))
        if grouped and s.groups:
            df = df.groupBy(*(g.lower(scope) for g in s.groups)).agg(*columns)
            df = df.select(*(F.col(c) for c in df.columns[len(s.groups) :])) if len(df.columns) > len(columns) else df
        else:
            df = df.select(*columns)
        if s.having_ is not None:
            df = df.filter("__h")
        dealt = {}
        if ROW_NUMBER in drawn(*late.values(), *by_number.values()):
            df, dealt = self.dealt(df, [ROW_NUMBER], "__r")
        last = replace(scope, tables={}, outer=None, dealt=dealt)
        if orders:
            df = df.withColumns({f"__o{k}": e.lower(last) for k, e in by_number.items()}) if by_number else df
            df = df.orderBy(*(o.apply(F.col(f"__o{k}")) for k, o in enumerate(orders)))
        if sequences:
            df, more = self.dealt(df if limit is None else df.limit(limit), sequences)
            last = replace(last, dealt=dealt | more)
        return df.select(*((late[k].lower(last) if k in late else F.col(f"__f{k}")).alias(n) for k, n in enumerate(names)))

    def _hinted(self, df: DataFrame, s: Select) -> DataFrame:
        """Hints never change a result: one that deals rows anew is left out where the select orders them."""
        for h in s.hints:
            if h.name == "custom" and h.args[0].upper() == "SPARK" and h.args[1].lower() in _SPARK_HINTS and not s.orders:
                df = df.hint(h.args[1])
            elif h.name == "parallel" and h.args and not s.orders:
                df = df.repartition(h.args[0])
        return df


def _plain(e: Expr) -> Expr:
    """A reference to an output column, whatever table it named."""
    return replace(e, table=None) if isinstance(e, Ref) else e
