"""The schema model: types, columns, tables, indexes, views, sequences; builders, validation and Spark mapping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    BOOLEAN = "BOOLEAN"
    DATE = "DATE"
    DECIMAL = "DECIMAL"
    STRING = "STRING"
    BIG_INTEGER = "BIG_INTEGER"
    INTEGER = "INTEGER"
    BLOB = "BLOB"
    CLOB = "CLOB"
    NULL = "NULL"

    @property
    def has_width(self) -> bool:
        return self in (DataType.STRING, DataType.DECIMAL)


def spark_type(type_: DataType, width: int = 0, scale: int = 0) -> T.DataType:
    plain = {DataType.BOOLEAN: T.BooleanType(), DataType.DATE: T.DateType(), DataType.STRING: T.StringType(), DataType.BIG_INTEGER: T.LongType(), DataType.INTEGER: T.IntegerType(), DataType.BLOB: T.BinaryType(), DataType.CLOB: T.StringType(), DataType.NULL: T.NullType()}
    return T.DecimalType(width or 38, scale) if type_ is DataType.DECIMAL else plain[type_]


@dataclass(frozen=True)
class Column:
    name: str
    type_: DataType
    width: int = 0
    scale: int = 0
    is_nullable: bool = False
    is_primary_key: bool = False
    default: str | None = None
    auto_from: int | None = None

    def nullable(self) -> Column:
        return replace(self, is_nullable=True)

    def primary_key(self) -> Column:
        return replace(self, is_primary_key=True)

    def not_primary_key(self) -> Column:
        return replace(self, is_primary_key=False)

    def default_value(self, value: str) -> Column:
        return replace(self, default=value)

    def auto_numbered(self, start: int = 1) -> Column:
        return replace(self, auto_from=start)

    @property
    def spark(self) -> T.StructField:
        about = {"quernel.type": self.type_.value, "quernel.width": self.width, "quernel.scale": self.scale, "quernel.pk": self.is_primary_key, "quernel.default": self.default or "", "quernel.auto": -1 if self.auto_from is None else self.auto_from}
        return T.StructField(self.name, spark_type(self.type_, self.width, self.scale), self.is_nullable, about)


@dataclass(frozen=True)
class Index:
    name: str
    column_names: tuple[str, ...] = ()
    is_unique: bool = False

    def columns(self, *names: str) -> Index:
        return replace(self, column_names=names)

    def unique(self) -> Index:
        return replace(self, is_unique=True)


@dataclass(frozen=True)
class Table:
    name: str
    column_list: tuple[Column, ...] = ()
    index_list: tuple[Index, ...] = ()
    temporary: bool = False

    def columns(self, *columns: Column) -> Table:
        return replace(self, column_list=columns)

    def indexes(self, *indexes: Index) -> Table:
        return replace(self, index_list=indexes)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.column_list if c.is_primary_key)

    def column(self, name: str) -> Column:
        return next(c for c in self.column_list if c.name.lower() == name.lower())

    def has_column(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.column_list)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.spark for c in self.column_list])


@dataclass(frozen=True)
class View:
    name: str
    select: object
    dependencies: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sequence:
    name: str
    starts_with: int = 1
    temporary: bool = False


@dataclass(frozen=True)
class Schema:
    """Tables, views and sequences; names are looked up whatever their case."""

    tables: tuple[Table, ...] = ()
    views: tuple[View, ...] = ()
    sequences: tuple[Sequence, ...] = ()

    def table(self, name: str) -> Table:
        found = [t for t in self.tables if t.name.lower() == name.lower()]
        if not found:
            raise KeyError(f"no table {name}")
        return found[0]

    def has_table(self, name: str) -> bool:
        return any(t.name.lower() == name.lower() for t in self.tables)

    def with_table(self, table: Table) -> Schema:
        """table in place of the one of its name, or added."""
        if not self.has_table(table.name):
            return replace(self, tables=(*self.tables, table))
        return replace(self, tables=tuple(table if t.name.lower() == table.name.lower() else t for t in self.tables))

    def without_table(self, name: str) -> Schema:
        return replace(self, tables=tuple(t for t in self.tables if t.name.lower() != name.lower()))

    @property
    def is_empty(self) -> bool:
        return not self.tables and not self.views


def column(name: str, type_: DataType, width: int = 0, scale: int = 0) -> Column:
    return Column(name, type_, width, scale)


def id_column() -> Column:
    return column("id", DataType.BIG_INTEGER).primary_key()


def version_column() -> Column:
    return column("version", DataType.INTEGER).nullable().default_value("0")


def table(name: str) -> Table:
    return Table(name)


def index(name: str) -> Index:
    return Index(name)


def view(name: str, select, *dependencies: str) -> View:
    return View(name, select, dependencies)


def sequence(name: str, starts_with: int = 1) -> Sequence:
    return Sequence(name, starts_with)


def schema(*parts) -> Schema:
    """A schema of tables, views, sequences and other schemas; the first of a name wins."""
    tables: dict[str, Table] = {}
    views: dict[str, View] = {}
    sequences: dict[str, Sequence] = {}
    for p in parts:
        for t in p.tables if isinstance(p, Schema) else [p] if isinstance(p, Table) else []:
            tables.setdefault(t.name.lower(), t)
        for v in p.views if isinstance(p, Schema) else [p] if isinstance(p, View) else []:
            views.setdefault(v.name.lower(), v)
        for s in p.sequences if isinstance(p, Schema) else [p] if isinstance(p, Sequence) else []:
            sequences.setdefault(s.name.lower(), s)
    return Schema(tuple(tables.values()), tuple(views.values()), tuple(sequences.values()))


class SchemaError(ValueError):
    """All that is wrong with a schema."""


LONGEST_NAME = 60
#: Words that can't be names.
RESERVED = frozenset("SELECT FROM WHERE TABLE INDEX VIEW ORDER GROUP BY HAVING UNION INSERT UPDATE DELETE MERGE INTO VALUES AND OR NOT NULL IN EXISTS LIKE BETWEEN CASE WHEN THEN ELSE END JOIN INNER LEFT RIGHT FULL OUTER CROSS ON AS DISTINCT ALL ANY SET CREATE ALTER DROP PRIMARY KEY UNIQUE DEFAULT CHECK CONSTRAINT COLUMN USER DATE".split())


def validate(s: Schema) -> None:
    """Collects every fault, then raises them together."""
    faults: list[str] = []

    def name_ok(kind: str, name: str) -> None:
        if not re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_]*", name):
            faults.append(f"{kind} name [{name}] has characters that aren't allowed")
        if len(name) > LONGEST_NAME:
            faults.append(f"{kind} name [{name}] is longer than {LONGEST_NAME}")
        if name.upper() in RESERVED:
            faults.append(f"{kind} name [{name}] is reserved")

    for t in s.tables:
        name_ok("table", t.name)
        seen: set[str] = set()
        for c in t.column_list:
            name_ok("column", c.name)
            if c.name.lower() in seen:
                faults.append(f"column [{c.name}] of [{t.name}] is there twice")
            seen.add(c.name.lower())
            if c.type_.has_width and not c.width:
                faults.append(f"column [{c.name}] of [{t.name}] needs a width")
            if c.is_primary_key and c.is_nullable:
                faults.append(f"column [{c.name}] of [{t.name}] is nullable in the primary key")
        signatures: dict[tuple, str] = {(tuple(x.lower() for x in t.primary_key), True): "primary key"} if t.primary_key else {}
        for i in t.index_list:
            name_ok("index", i.name)
            key = (tuple(x.lower() for x in i.column_names), i.is_unique)
            if key[0] == ("id",):
                faults.append(f"index [{i.name}] of [{t.name}] is on id alone")
            if key in signatures:
                faults.append(f"index [{i.name}] of [{t.name}] repeats {signatures[key]}")
            signatures[key] = i.name
            faults += [f"index [{i.name}] of [{t.name}] has unknown column [{x}]" for x in i.column_names if not t.has_column(x)]
    for v in s.views:
        name_ok("view", v.name)
    if faults:
        raise SchemaError("\n".join(faults))


def differences(a: Schema, b: Schema, ignore_extra: tuple[str, ...] = ()) -> list[str]:
    """What sets two schemas apart, by upper-case names; ``ignore_extra`` has patterns of tables that only one side has."""
    out: list[str] = []
    ta, tb = ({t.name.upper(): t for t in s.tables} for s in (a, b))
    skipped = lambda n: any(re.fullmatch(p, n, re.I) for p in ignore_extra)
    for n in sorted(ta.keys() ^ tb.keys()):
        if not skipped(n):
            out.append(f"table [{n}] is only in the {'first' if n in ta else 'second'} schema")
    for n in sorted(ta.keys() & tb.keys()):
        out += table_differences(ta[n], tb[n])
    return out


def table_differences(a: Table, b: Table) -> list[str]:
    out: list[str] = []
    ca, cb = ({c.name.upper(): c for c in t.column_list} for t in (a, b))
    for n in sorted(ca.keys() ^ cb.keys()):
        out.append(f"column [{n}] of [{a.name}] is only in the {'first' if n in ca else 'second'} table")
    for n in sorted(ca.keys() & cb.keys()):
        x, y = ca[n], cb[n]
        for what in ("type_", "is_nullable", "is_primary_key", "default", "auto_from"):
            if (getattr(x, what) or None) != (getattr(y, what) or None):
                out.append(f"column [{n}] of [{a.name}]: {what.strip('_')} {getattr(x, what)} and {getattr(y, what)}")
        if x.type_ is y.type_ and x.type_.has_width and (x.width != y.width or x.type_ is DataType.DECIMAL and x.scale != y.scale):
            out.append(f"column [{n}] of [{a.name}]: width {x.width},{x.scale} and {y.width},{y.scale}")
    pa_, pb = (tuple(x.upper() for x in t.primary_key) for t in (a, b))
    if pa_ != pb and set(pa_) == set(pb):
        out.append(f"primary key of [{a.name}]: {pa_} and {pb}")
    shape = lambda t: {i.name.upper(): (tuple(x.upper() for x in i.column_names), i.is_unique) for i in t.index_list}
    ia, ib = shape(a), shape(b)
    for n in sorted(ia.keys() | ib.keys()):
        if ia.get(n) != ib.get(n):
            out.append(f"index [{n}] of [{a.name}]: {ia.get(n)} and {ib.get(n)}")
    return out


@dataclass
class Counters:
    """Sequences' values, kept by the driver."""

    values: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)

    def create(self, s: Sequence) -> None:
        self.starts[s.name.lower()] = s.starts_with

    def drop(self, name: str) -> None:
        self.starts.pop(name.lower(), None)
        self.values.pop(name.lower(), None)

    def reserve(self, name: str, n: int) -> int:
        """The first of n new values."""
        key = name.lower()
        first = self.values.get(key, self.starts.get(key, 1) - 1) + 1
        self.values[key] = first + n - 1
        return first

    def next(self, name: str) -> int:
        return self.reserve(name, 1)

    def current(self, name: str) -> int:
        return self.values.get(name.lower(), self.starts.get(name.lower(), 1))


# -- adapters ---------------------------------------------------------------------------------------


def filtered(s: Schema, keep) -> Schema:
    """Only the tables that ``keep``, names or a test of a name, lets through."""
    if not callable(keep):
        names = {n.lower() for n in keep}
        keep = lambda n: n.lower() in names
    return replace(s, tables=tuple(t for t in s.tables if keep(t.name)))


def augmented(s: Schema, *tables: Table) -> Schema:
    """s with more tables; those that it has stay."""
    return schema(s, *tables)


def overridden(s: Schema, *tables: Table) -> Schema:
    """s with tables in place of its own of the same names."""
    for t in tables:
        s = s.with_table(t)
    return s


def decorated(s: Schema, prefix: str) -> Schema:
    """s with a prefix before each table's name."""
    return replace(s, tables=tuple(replace(t, name=f"{prefix}{t.name}") for t in s.tables))


def altered(t: Table, columns: tuple[str, ...]) -> Table:
    """t with some of its columns, in a stated order."""
    return replace(t, column_list=tuple(t.column(c) for c in columns))
