"""Expressions of the query DSL: immutable trees that lower to Spark columns within a scope."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quernel.sources.schema import DataType, spark_type


#: Under this name row numbers are dealt beside next values; no sequence can have it.
ROW_NUMBER = "row_number()"


class DslError(ValueError):
    """A statement that the DSL doesn't allow."""


@dataclass
class Scope:
    """What field references mean here: table aliases and their columns, the enclosing scope, parameters and a way to lower subselects.

    ``dealt`` has the columns of row numbers and of each sequence's next values where they were dealt to rows; a scope of one row draws them itself.
    """

    tables: dict[str, set[str]]
    outer: Scope | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    subselect: Callable | None = None
    sequences: Any = None
    dealt: dict[str, Column] = field(default_factory=dict)
    one_row: bool = False

    def depth(self, table: str | None, name: str) -> int:
        """0 for this scope, 1 and up for enclosing ones; unknown names count as this scope's."""
        scope, k = self, 0
        while scope is not None:
            if (table.lower() in scope.tables) if table else any(name.lower() in c for c in scope.tables.values()):
                return k
            scope, k = scope.outer, k + 1
        return 0


@dataclass(frozen=True)
class Expr:
    """Base of all fields; operators give new fields."""

    def lower(self, scope: Scope) -> Column:
        raise NotImplementedError

    def children(self) -> Iterator[Expr]:
        for f in fields(self):
            yield from _expressions(getattr(self, f.name))

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def as_(self, name: str) -> Alias:
        return Alias(self.expr if isinstance(self, Alias) else self, name)

    @property
    def implied_name(self) -> str:
        return ""

    def _maths(self, op: str, other) -> Maths:
        return Maths(self, op, wrap(other), True)

    def plus(self, other) -> Maths:
        return self._maths("+", other)

    def minus(self, other) -> Maths:
        return self._maths("-", other)

    def multiply_by(self, other) -> Maths:
        return self._maths("*", other)

    def divide_by(self, other) -> Maths:
        return self._maths("/", other)

    def negated(self) -> Maths:
        return Literal(0).minus(self)

    def eq(self, other) -> Compare:
        return Compare("=", self, wrap(other))

    def neq(self, other) -> Compare:
        return Compare("<>", self, wrap(other))

    def less_than(self, other) -> Compare:
        return Compare("<", self, wrap(other))

    def greater_than(self, other) -> Compare:
        return Compare(">", self, wrap(other))

    def less_than_or_equal_to(self, other) -> Compare:
        return Compare("<=", self, wrap(other))

    def greater_than_or_equal_to(self, other) -> Compare:
        return Compare(">=", self, wrap(other))

    def like(self, pattern) -> Like:
        return Like(self, wrap(pattern))

    def is_null(self) -> IsNull:
        return IsNull(self, True)

    def is_not_null(self) -> IsNull:
        return IsNull(self, False)

    def in_(self, *items) -> Criterion:
        if len(items) == 1 and hasattr(items[0], "from_"):
            if len(items[0].fields_) != 1:
                raise DslError("a subselect for IN must have one field")
            return InSelect(self, items[0])
        if len(items) == 1 and isinstance(items[0], list | tuple | set):
            items = tuple(items[0])
        return InList(self, tuple(map(wrap, items)))

    def asc(self) -> Order:
        return Order(self, True, None)

    def desc(self) -> Order:
        return Order(self, False, None)

    def nulls_first(self) -> Order:
        return Order(self, True, True)

    def nulls_last(self) -> Order:
        return Order(self, True, False)

    def cast(self, type_: DataType, width: int = 0, scale: int = 0) -> Cast:
        return Cast(self, type_, width, scale)

    def as_string(self, width: int) -> Cast:
        return self.cast(DataType.STRING, width)

    def as_decimal(self, width: int, scale: int = 0) -> Cast:
        return self.cast(DataType.DECIMAL, width, scale)

    def as_date(self) -> Cast:
        return self.cast(DataType.DATE)


def _expressions(value) -> Iterator[Expr]:
    if isinstance(value, Expr):
        yield value
    elif isinstance(value, tuple | list):
        for v in value:
            yield from _expressions(v)
    elif is_dataclass(value) and hasattr(value, "expressions"):
        yield from value.expressions()


@dataclass(frozen=True)
class Alias(Expr):
    expr: Expr
    name: str

    def lower(self, scope):
        return self.expr.lower(scope)

    @property
    def implied_name(self):
        return self.name


@dataclass(frozen=True)
class Ref(Expr):
    """A column, by name or by table (or table alias) and name."""

    name: str
    table: str | None = None

    def lower(self, scope):
        c = F.col(f"`{self.table}`.`{self.name}`" if self.table else f"`{self.name}`")
        return c.outer() if scope.depth(self.table, self.name) else c

    @property
    def implied_name(self):
        return self.name


@dataclass(frozen=True)
class Literal(Expr):
    """A value. The empty string is null, as the DSL has it for literals."""

    value: Any
    type_: str | None = None

    def lower(self, scope):
        v = self.value
        if isinstance(v, str) and v == "" or v is None:
            return F.lit(None).cast(self.type_ or ("string" if v == "" else "void"))
        if isinstance(v, bytes):
            return F.lit(bytearray(v))
        if isinstance(v, bool):
            return F.lit(v)
        if isinstance(v, int) and not -(2**31) <= v < 2**31:
            return F.lit(v).cast("bigint")
        return F.lit(v).cast(self.type_) if self.type_ else F.lit(v)


def wrap(value) -> Expr:
    """Plain values as literals."""
    if isinstance(value, Expr):
        return value
    if hasattr(value, "as_field"):
        return value.as_field()
    if value is None or isinstance(value, str | int | float | bool | bytes | Decimal | dt.date | dt.datetime):
        return Literal(value)
    raise DslError(f"not a field: {value!r}")


@dataclass(frozen=True)
class Parameter(Expr):
    """A named parameter with a type; an empty string binds null."""

    name: str
    type_: DataType = DataType.STRING
    width: int = 0
    scale: int = 0

    def lower(self, scope):
        if self.name not in scope.parameters:
            raise DslError(f"no value for parameter {self.name}")
        v = scope.parameters[self.name]
        return F.lit(None if v == "" else bytearray(v) if isinstance(v, bytes) else v).cast(spark_type(self.type_, self.width, self.scale))

    @property
    def implied_name(self):
        return self.name


@dataclass(frozen=True)
class Bracket(Expr):
    expr: Expr

    def lower(self, scope):
        return self.expr.lower(scope)


_OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


@dataclass(frozen=True)
class Maths(Expr):
    """Arithmetic that is read like the text it would be: only a right operand made by plus() and so on is bracketed."""

    left: Expr
    op: str
    right: Expr
    bracket_right: bool = False

    def tokens(self) -> list:
        side = lambda e, bracket: [Bracket(e)] if bracket and isinstance(e, Maths) else e.tokens() if isinstance(e, Maths) else [e]
        return [*side(self.left, False), self.op, *side(self.right, self.bracket_right)]

    def lower(self, scope):
        terms: list = []
        pending = None
        for t in self.tokens():
            if isinstance(t, str):
                pending = t
                continue
            value = t.lower(scope)
            if pending in ("*", "/"):
                terms[-1] = _OPS[pending](terms[-1], value)
            else:
                terms += [pending, value] if pending else [value]
        out = terms[0]
        for op, value in zip(terms[1::2], terms[2::2], strict=True):
            out = _OPS[op](out, value)
        return out


@dataclass(frozen=True)
class Cast(Expr):
    expr: Expr
    type_: DataType
    width: int = 0
    scale: int = 0

    def lower(self, scope):
        c = self.expr.lower(scope).cast(spark_type(self.type_, self.width, self.scale))
        return F.substring(c, 1, self.width) if self.type_ is DataType.STRING and self.width else c

    @property
    def implied_name(self):
        return self.expr.implied_name


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Criterion, Expr], ...]
    default: Expr | None = None

    def otherwise(self, value) -> Case:
        return replace(self, default=wrap(value))

    def children(self):
        for c, v in self.whens:
            yield c
            yield v
        if self.default is not None:
            yield self.default

    def lower(self, scope):
        if not self.whens or self.default is None:
            raise DslError("CASE needs WHEN and ELSE")
        out = F
        for c, v in self.whens:
            out = out.when(c.lower(scope), v.lower(scope))
        return out.otherwise(self.default.lower(scope))


@dataclass(frozen=True)
class When:
    criterion: Criterion

    def then(self, value) -> tuple[Criterion, Expr]:
        return self.criterion, wrap(value)


@dataclass(frozen=True)
class Concat(Expr):
    """Strings one after the other; nulls count as empty."""

    parts: tuple[Expr, ...]

    def lower(self, scope):
        return F.concat_ws("", *(p.lower(scope).cast("string") for p in self.parts))


@dataclass(frozen=True)
class Function(Expr):
    """A scalar or aggregate function by name; see quernel.functions."""

    name: str
    args: tuple[Expr, ...]
    build: Callable[..., Column] = field(compare=False)
    aggregate: bool = False
    windowed: bool = False

    def lower(self, scope):
        return self.build(*(a.lower(scope) for a in self.args))


@dataclass(frozen=True)
class RowNumber(Function):
    """A number from 1 for each row, in no stated order: dealt to rows where a select or a data change can, else one task's window."""

    def lower(self, scope):
        return scope.dealt[ROW_NUMBER] if ROW_NUMBER in scope.dealt else self.build()


@dataclass(frozen=True)
class WindowFunction(Expr):
    """An aggregate or row number over a partition; with an order, rows up to the current one and its peers."""

    function: Function
    partition: tuple[Expr, ...] = ()
    order: tuple[Order, ...] = ()

    def partition_by(self, *by) -> WindowFunction:
        return replace(self, partition=tuple(map(wrap, by)))

    def order_by(self, *by) -> WindowFunction:
        return replace(self, order=tuple(map(ordering, by)))

    def children(self):
        yield from self.function.args
        yield from self.partition
        for o in self.order:
            yield o.expr

    def lower(self, scope):
        if not self.function.windowed:
            raise DslError(f"{self.function.name} is not a window function")
        if self.function.name == "row_number" and not self.order:
            raise DslError("row_number needs an order")
        w = Window.partitionBy(*(p.lower(scope) for p in self.partition))
        return self.function.lower(scope).over(w.orderBy(*(o.lower(scope) for o in self.order)) if self.order else w)


@dataclass(frozen=True)
class SelectField(Expr):
    """A subselect of one field as a value; it may refer to fields outside."""

    select: Any

    def children(self):
        return iter(())

    def lower(self, scope):
        if len(self.select.fields_) != 1:
            raise DslError("a subselect as a field must have one field")
        return scope.subselect(self.select, scope).scalar()


@dataclass(frozen=True)
class SequenceValue(Expr):
    name: str
    next_: bool

    def lower(self, scope):
        if scope.sequences is None:
            raise DslError("no sequences here")
        if self.name.lower() in scope.dealt:
            return scope.dealt[self.name.lower()]
        if self.next_ and not scope.one_row:
            raise DslError("next values are for fields of selects, values of inserts and sets of updates")
        return F.lit(scope.sequences.next(self.name) if self.next_ else scope.sequences.current(self.name)).cast("bigint")


@dataclass(frozen=True)
class Native(Expr):
    """Text for Spark's own parser, by engine name; only SPARK is run here."""

    texts: tuple[tuple[str, str], ...]

    def lower(self, scope):
        by = dict(self.texts)
        if "SPARK" not in by:
            raise DslError("no SPARK expression given")
        return F.expr(by["SPARK"])


@dataclass(frozen=True)
class NativeFunction(Expr):
    """A function by its Spark name, registered ones included."""

    names: tuple[tuple[str, str], ...]
    args: tuple[Expr, ...]

    def lower(self, scope):
        by = dict(self.names)
        if "SPARK" not in by:
            raise DslError("no SPARK function given")
        return F.call_function(by["SPARK"], *(a.lower(scope) for a in self.args))


@dataclass(frozen=True)
class Order:
    expr: Expr
    ascending: bool = True
    first: bool | None = None  # of nulls; None: first ascending, last descending

    def asc(self) -> Order:
        return replace(self, ascending=True)

    def desc(self) -> Order:
        return replace(self, ascending=False)

    def nulls_first(self) -> Order:
        return replace(self, first=True)

    def nulls_last(self) -> Order:
        return replace(self, first=False)

    def no_null_handling(self) -> Order:
        return replace(self, first=None)

    def expressions(self):
        yield self.expr

    def apply(self, c: Column) -> Column:
        first = self.ascending if self.first is None else self.first
        return {(True, True): c.asc_nulls_first, (True, False): c.asc_nulls_last, (False, True): c.desc_nulls_first, (False, False): c.desc_nulls_last}[self.ascending, first]()

    def lower(self, scope) -> Column:
        return self.apply(self.expr.lower(scope))


def ordering(value) -> Order:
    return value if isinstance(value, Order) else Order(wrap(value))


@dataclass(frozen=True)
class Criterion(Expr):
    """A condition; as a field it is a boolean."""


@dataclass(frozen=True)
class Compare(Criterion):
    op: str
    left: Expr
    right: Expr

    def lower(self, scope):
        a, b = self.left.lower(scope), self.right.lower(scope)
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[self.op]

    def inverted(self) -> Compare:
        return replace(self, op={"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}[self.op])


@dataclass(frozen=True)
class IsNull(Criterion):
    expr: Expr
    null: bool

    def lower(self, scope):
        c = self.expr.lower(scope)
        return c.isNull() if self.null else c.isNotNull()

    def inverted(self) -> IsNull:
        return replace(self, null=not self.null)


@dataclass(frozen=True)
class Like(Criterion):
    expr: Expr
    pattern: Expr

    def lower(self, scope):
        if isinstance(self.pattern, Literal):
            return self.expr.lower(scope).like(self.pattern.value)
        return F.like(self.expr.lower(scope), self.pattern.lower(scope))


@dataclass(frozen=True)
class InList(Criterion):
    expr: Expr
    items: tuple[Expr, ...]

    def lower(self, scope):
        return self.expr.lower(scope).isin(*(i.lower(scope) for i in self.items))


@dataclass(frozen=True)
class InSelect(Criterion):
    expr: Expr
    select: Any

    def children(self):
        yield self.expr

    def lower(self, scope):
        return self.expr.lower(scope).isin(scope.subselect(self.select, scope))


@dataclass(frozen=True)
class Exists(Criterion):
    select: Any

    def children(self):
        return iter(())

    def lower(self, scope):
        return scope.subselect(self.select, scope).exists()


@dataclass(frozen=True)
class Many(Criterion):
    op: str
    items: tuple[Criterion, ...]

    def lower(self, scope):
        if not self.items:
            raise DslError(f"{self.op} needs a condition")
        return reduce(lambda a, b: a & b if self.op == "AND" else a | b, (i.lower(scope) for i in self.items))


@dataclass(frozen=True)
class Not(Criterion):
    item: Criterion

    def lower(self, scope):
        return ~self.item.lower(scope)


def contains_aggregate(e: Expr) -> bool:
    if isinstance(e, WindowFunction):
        return False
    return isinstance(e, Function) and e.aggregate or any(contains_aggregate(c) for c in e.children())


def drawn(*exprs: Expr) -> list[str]:
    """The sequences that expressions take next values of; row numbers count as one."""
    return sorted({x.name.lower() for e in exprs for x in e.walk() if isinstance(x, RowNumber) or isinstance(x, SequenceValue) and x.next_})


def postponed(e: Expr, early: list[Expr]) -> Expr:
    """e over next values that come later: parts without them go to ``early``, in place of them are references to __a0, __a1, ..."""
    if isinstance(e, Literal | SequenceValue | RowNumber):
        return e
    if not drawn(e):
        early.append(e)
        return Ref(f"__a{len(early) - 1}")
    if isinstance(e, WindowFunction) or isinstance(e, Function) and e.aggregate:
        raise DslError("no aggregates or windows of next values")

    def part(v):
        return postponed(v, early) if isinstance(v, Expr) else type(v)(map(part, v)) if isinstance(v, tuple | list) else v

    return replace(e, **{f.name: part(getattr(e, f.name)) for f in fields(e)})


# -- builders ---------------------------------------------------------------------------------------


def field_(name: str, table: str | None = None) -> Ref:
    return Ref(name, table)


def literal(value) -> Literal:
    return Literal(value)


def null_literal() -> Literal:
    return Literal(None)


def blob_literal(value: bytes | str) -> Literal:
    return Literal(value.encode() if isinstance(value, str) else bytes(value))


def clob_literal(value: str) -> Literal:
    return Literal(value)


def parameter(name: str, type_: DataType = DataType.STRING, width: int = 0, scale: int = 0) -> Parameter:
    return Parameter(name, type_, width, scale)


def bracket(e: Expr) -> Bracket:
    return Bracket(e)


def math(left, op: str, right) -> Maths:
    return Maths(wrap(left), op, wrap(right), False)


def when(*criteria: Criterion) -> When:
    return When(criteria[0] if len(criteria) == 1 else and_(*criteria))


def case(*whens) -> Case:
    return Case(tuple(whens))


def concat(*parts) -> Concat:
    return Concat(tuple(map(wrap, parts)))


def window(function: Function) -> WindowFunction:
    return WindowFunction(function)


def next_value(sequence: str) -> SequenceValue:
    return SequenceValue(sequence, True)


def current_value(sequence: str) -> SequenceValue:
    return SequenceValue(sequence, False)


def native(**texts: str) -> Native:
    return Native(tuple((k.upper(), v) for k, v in texts.items()))


def native_function(names: dict[str, str], *args) -> NativeFunction:
    return NativeFunction(tuple((k.upper(), v) for k, v in names.items()), tuple(map(wrap, args)))


def _flat(items) -> tuple[Criterion, ...]:
    return tuple(items[0]) if len(items) == 1 and isinstance(items[0], list | tuple) else tuple(items)


def and_(*items) -> Many:
    return Many("AND", _flat(items))


def or_(*items) -> Many:
    return Many("OR", _flat(items))


def not_(item: Criterion) -> Not:
    return Not(item)


def exists(select) -> Exists:
    return Exists(select)


def null_if_zero(e: Expr) -> Case:
    return case(when(e.eq(0)).then(None)).otherwise(e)


def is_empty(e: Expr) -> Criterion:
    from quernel import functions as fn

    return fn.coalesce(fn.length(fn.trim(e)), 0).eq(0)


def is_not_empty(e: Expr) -> Criterion:
    from quernel import functions as fn

    return and_(e.is_not_null(), fn.coalesce(fn.length(fn.trim(e)), 0).greater_than(0))
