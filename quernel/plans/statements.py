"""Statements of the DSL: immutable descriptions of queries and data changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from quernel.plans.expr import Alias, Criterion, DslError, Expr, Order, Ref, SelectField, _expressions, and_, ordering, wrap


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None
    schema_name: str | None = None
    db_link: str | None = None
    temporary: bool = False

    def as_(self, alias: str) -> TableRef:
        return replace(self, alias=alias)

    def in_schema(self, name: str) -> TableRef:
        return replace(self, schema_name=name)

    def field(self, name: str) -> Ref:
        return Ref(name, self.alias or self.name)


def table_ref(name: str) -> TableRef:
    return TableRef(name)


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, full, cross
    source: Any
    on: Criterion | None = None

    def expressions(self) -> Iterator[Expr]:
        if self.on is not None:
            yield self.on


@dataclass(frozen=True)
class Hint:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class SetOp:
    kind: str  # union, union_all, except
    select: Any


@dataclass(frozen=True)
class Select:
    """A query. Without fields it selects everything; without sources it gives one row."""

    fields_: tuple[Expr, ...] = ()
    is_distinct: bool = False
    sources: tuple[Any, ...] = ()
    joins: tuple[Join, ...] = ()
    criterion: Criterion | None = None
    groups: tuple[Expr, ...] = ()
    having_: Criterion | None = None
    orders: tuple[Order, ...] = ()
    set_ops: tuple[SetOp, ...] = ()
    row_limit: int | None = None
    alias: str | None = None
    hints: tuple[Hint, ...] = ()
    locking: bool = False
    first_only: bool = False

    def from_(self, *sources) -> Select:
        return replace(self, sources=tuple(TableRef(s) if isinstance(s, str) else s for s in sources))

    def _join(self, kind: str, source, on: Criterion | None) -> Select:
        source = TableRef(source) if isinstance(source, str) else source
        if isinstance(source, Select) and not source.alias:
            raise DslError("a joined subselect needs an alias")
        if kind in ("left", "full") and on is None:
            raise DslError("an outer join needs a condition")
        return replace(self, joins=(*self.joins, Join("cross" if on is None else kind, source, on)))

    def inner_join(self, source, on: Criterion | None = None) -> Select:
        return self._join("inner", source, on)

    def cross_join(self, source) -> Select:
        return self._join("cross", source, None)

    def left_outer_join(self, source, on: Criterion) -> Select:
        return self._join("left", source, on)

    def full_outer_join(self, source, on: Criterion) -> Select:
        return self._join("full", source, on)

    def where(self, *criteria) -> Select:
        items = list(criteria[0]) if len(criteria) == 1 and isinstance(criteria[0], list | tuple) else list(criteria)
        return replace(self, criterion=items[0] if len(items) == 1 else and_(*items))

    def group_by(self, *fields_) -> Select:
        return replace(self, groups=tuple(map(wrap, fields_)))

    def having(self, criterion: Criterion) -> Select:
        return replace(self, having_=criterion)

    def order_by(self, *orders) -> Select:
        return replace(self, orders=tuple(map(ordering, orders)))

    def limit(self, n: int) -> Select:
        if n < 1:
            raise DslError("a limit is 1 at least")
        return replace(self, row_limit=n)

    def as_(self, alias: str) -> Select:
        return replace(self, alias=alias)

    def as_field(self) -> SelectField:
        return SelectField(self)

    def _set(self, kind: str, other: Select) -> Select:
        if len(other.fields_) != len(self.fields_):
            raise DslError("both sides of a set operation need the same number of fields")
        if other.orders:
            raise DslError("an inner select of a set operation can't be ordered")
        return replace(self, set_ops=(*self.set_ops, SetOp(kind, other)))

    def union(self, other: Select) -> Select:
        return self._set("union", other)

    def union_all(self, other: Select) -> Select:
        return self._set("union_all", other)

    def except_(self, other: Select) -> Select:
        return self._set("except", other)

    def for_update(self) -> Select:
        if self.is_distinct or self.groups or self.joins:
            raise DslError("rows can't be locked with DISTINCT, GROUP BY or joins")
        return replace(self, locking=True)

    def hint(self, name: str, *args) -> Select:
        return replace(self, hints=(*self.hints, Hint(name, args)))

    def optimise_for_row_count(self, n: int) -> Select:
        return self.hint("row_count", n)

    def use_index(self, table: str, index: str) -> Select:
        return self.hint("use_index", table, index)

    def use_implicit_join_order(self) -> Select:
        return self.hint("join_order")

    def parallel(self, n: int | None = None) -> Select:
        return self.hint("parallel", *([] if n is None else [n]))

    def custom_hint(self, engine: str, text: str) -> Select:
        return self.hint("custom", engine, text)

    def field(self, name: str) -> Ref:
        return Ref(name, self.alias)

    def expressions(self) -> Iterator[Expr]:
        yield from _expressions((self.fields_, self.groups))
        for x in (self.criterion, self.having_):
            if x is not None:
                yield x
        for j in self.joins:
            yield from j.expressions()
        for o in self.orders:
            yield o.expr


def select(*fields_) -> Select:
    return Select(tuple(map(wrap, fields_)))


def select_distinct(*fields_) -> Select:
    return Select(tuple(map(wrap, fields_)), is_distinct=True)


def select_first(field_) -> Select:
    """One field of the first row in the select's order."""
    return Select((wrap(field_),), row_limit=1, first_only=True)


@dataclass(frozen=True)
class Insert:
    table: str
    targets: tuple[str, ...] = ()
    source: Any = None  # Select or table name
    rows: tuple[tuple[Alias, ...], ...] = ()
    defaults: tuple[Alias, ...] | None = None

    def fields(self, *names) -> Insert:
        if not all(isinstance(n, str | Ref) for n in names):
            raise DslError("target fields are plain references")
        return replace(self, targets=tuple(n.name if isinstance(n, Ref) else n for n in names))

    def from_(self, source) -> Insert:
        source = source.name if isinstance(source, TableRef) else source
        if isinstance(source, Select) and self.targets and source.fields_ and len(source.fields_) != len(self.targets):
            raise DslError("as many fields as targets are needed")
        return replace(self, source=source)

    def values(self, *values: Alias) -> Insert:
        if not all(isinstance(v, Alias) for v in values):
            raise DslError("each value needs an alias, its column")
        return replace(self, rows=(*self.rows, tuple(values)))

    def with_defaults(self, *values: Alias) -> Insert:
        return replace(self, defaults=tuple(values))


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[Alias, ...] = ()
    criterion: Criterion | None = None

    def set(self, *values: Alias) -> Update:
        return replace(self, sets=(*self.sets, *values))

    def where(self, criterion: Criterion) -> Update:
        return replace(self, criterion=criterion)


@dataclass(frozen=True)
class Delete:
    table: str
    criterion: Criterion | None = None
    row_limit: int | None = None

    def where(self, criterion: Criterion) -> Delete:
        return replace(self, criterion=criterion)

    def limit(self, n: int) -> Delete:
        return replace(self, row_limit=n)


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class Merge:
    """Rows of a select update the rows with the same key, or else are inserted.

    In ``updating`` and ``only_where``, fields of the table ``existing`` are the target's, of ``input`` the select's.
    """

    table: str
    keys: tuple[str, ...] = ()
    source: Select | None = None
    updating: tuple[Alias, ...] = ()
    only_where_: Criterion | None = None

    def table_unique_key(self, *names) -> Merge:
        return replace(self, keys=tuple(n.name if isinstance(n, Ref) else n for n in names))

    def from_(self, source: Select) -> Merge:
        if source.hints:
            raise DslError("the source of a merge can't have hints")
        return replace(self, source=source)

    def if_updating(self, *overrides: Alias) -> Merge:
        for o in overrides:
            if o.name.lower() in [k.lower() for k in self.keys]:
                raise DslError("a key can't be updated")
        return replace(self, updating=overrides)

    def only_where(self, criterion: Criterion) -> Merge:
        return replace(self, only_where_=criterion)


def existing(name: str) -> Ref:
    return Ref(name, "existing")


def incoming(name: str) -> Ref:
    return Ref(name, "input")


def insert() -> _Into:
    return _Into()


class _Into:
    def into(self, table) -> Insert:
        return Insert(table.name if isinstance(table, TableRef) else table)


def update(table) -> Update:
    return Update(table.name if isinstance(table, TableRef) else table)


def delete(table) -> Delete:
    return Delete(table.name if isinstance(table, TableRef) else table)


def truncate(table) -> Truncate:
    return Truncate(table.name if isinstance(table, TableRef) else table)


class merge:  # noqa: N801
    """merge().into(table) begins a merge."""

    @staticmethod
    def into(table) -> Merge:
        return Merge(table.name if isinstance(table, TableRef) else table)


def parameters(statement) -> list:
    """Every parameter of a statement, subselects included, in order of appearance."""
    from quernel.plans.expr import Exists, InSelect, Parameter

    out: list = []

    def visit(s) -> None:
        for e in s.expressions() if hasattr(s, "expressions") else _expressions((getattr(s, "sets", ()), getattr(s, "rows", ()), getattr(s, "criterion", None), getattr(s, "updating", ()))):
            for x in e.walk():
                if isinstance(x, Parameter) and x not in out:
                    out.append(x)
                if isinstance(x, Exists | InSelect | SelectField):
                    visit(x.select)
        if isinstance(s, Select):
            for x in [*s.sources, *(j.source for j in s.joins), *(o.select for o in s.set_ops)]:
                if isinstance(x, Select):
                    visit(x)
        elif isinstance(getattr(s, "source", None), Select):
            visit(s.source)

    visit(statement)
    return out
