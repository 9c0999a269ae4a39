"""Evolution: ordered, reversible changes of schema and data, found, verified, audited and run serially or by graph."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import threading
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.sources.schema import Column, DataType, Index, Schema, Sequence, Table, column, differences, spark_type, table


class EvolutionError(ValueError):
    """A change that can't be made, or a path that doesn't lead to the target."""


def _swap(items: tuple, old_name: str, new) -> tuple:
    return tuple(x for i in items for x in ([i] if i.name.lower() != old_name.lower() else [] if new is None else [new]))


class Change:
    """A change of one schema object: forward and back on schemas, and on the table's rows."""

    table: str

    def apply(self, s: Schema) -> Schema:
        raise NotImplementedError

    def reverse(self, s: Schema) -> Schema:
        raise NotImplementedError

    def rewrite(self, df: DataFrame) -> DataFrame:
        return df

    def run(self, engine) -> None:
        if engine.has_table(self.table):
            engine.put(self.table, self.rewrite(engine.table(self.table)))

    @property
    def modifies(self) -> set[str]:
        return {self.table.lower()}


@dataclass(frozen=True)
class AddColumn(Change):
    table: str
    column: Column
    value: object = None

    def apply(self, s):
        t = s.table(self.table)
        if t.has_column(self.column.name):
            raise EvolutionError(f"column {self.column.name} of {self.table} is there already")
        if not self.column.is_nullable and self.value is None and self.column.default is None:
            raise EvolutionError(f"column {self.column.name} needs a value for existing rows")
        return s.with_table(replace(t, column_list=(*t.column_list, self.column)))

    def reverse(self, s):
        t = s.table(self.table)
        return s.with_table(replace(t, column_list=_swap(t.column_list, self.column.name, None)))

    def rewrite(self, df):
        value = self.value if self.value is not None else self.column.default
        return df.withColumn(self.column.name, F.lit(value).cast(self.column.spark.dataType))


@dataclass(frozen=True)
class RemoveColumn(Change):
    table: str
    column: Column

    def apply(self, s):
        t = s.table(self.table)
        if not t.has_column(self.column.name):
            raise EvolutionError(f"no column {self.column.name} in {self.table}")
        if any(self.column.name.lower() in (c.lower() for c in i.column_names) for i in t.index_list):
            raise EvolutionError(f"column {self.column.name} is part of an index")
        return s.with_table(replace(t, column_list=_swap(t.column_list, self.column.name, None)))

    def reverse(self, s):
        t = s.table(self.table)
        return s.with_table(replace(t, column_list=(*t.column_list, self.column)))

    def rewrite(self, df):
        return df.drop(self.column.name)


@dataclass(frozen=True)
class ChangeColumn(Change):
    table: str
    old: Column
    new: Column

    def __post_init__(self):
        a, b = self.old, self.new
        if a.type_ is not b.type_ and (a.type_, b.type_) != (DataType.DECIMAL, DataType.BIG_INTEGER):
            raise EvolutionError(f"{a.type_.value} can't become {b.type_.value}")
        if a.type_ is DataType.DECIMAL and b.type_ is DataType.DECIMAL and (b.width - b.scale < a.width - a.scale or b.scale < a.scale):
            raise EvolutionError(f"column {a.name} would lose digits")

    def _change(self, s, a: Column, b: Column, check: bool) -> Schema:
        t = s.table(self.table)
        if not t.has_column(a.name) or check and t.column(a.name) != a:
            raise EvolutionError(f"column {a.name} of {self.table} isn't as stated")
        if a.name.lower() != b.name.lower() and t.has_column(b.name):
            raise EvolutionError(f"column {b.name} of {self.table} is there already")
        indexes = tuple(replace(i, column_names=tuple(b.name if c.lower() == a.name.lower() else c for c in i.column_names)) for i in t.index_list)
        return s.with_table(replace(t, column_list=_swap(t.column_list, a.name, b), index_list=indexes))

    def apply(self, s):
        return self._change(s, self.old, self.new, True)

    def reverse(self, s):
        return self._change(s, self.new, self.old, False)

    def rewrite(self, df):
        def one(f):
            if f.name.lower() != self.old.name.lower():
                return F.col(f"`{f.name}`")
            c = F.col(f"`{f.name}`").cast(spark_type(self.new.type_, self.new.width, self.new.scale))
            if self.new.type_ is DataType.STRING and self.new.width < self.old.width:
                c = F.substring(c, 1, self.new.width)
            if self.old.is_nullable and not self.new.is_nullable and self.new.default is not None:
                c = F.coalesce(c, F.lit(self.new.default).cast(self.new.spark.dataType))
            return c.alias(self.new.name)

        return df.select(*map(one, df.schema))


@dataclass(frozen=True)
class AddTable(Change):
    definition: Table
    select: object = None  # its rows, if any

    @property
    def table(self):
        return self.definition.name

    def apply(self, s):
        if s.has_table(self.table):
            raise EvolutionError(f"table {self.table} is there already")
        if self.select is not None and len(self.select.fields_) != len(self.definition.column_list):
            raise EvolutionError("the select has another number of fields than the table")
        return s.with_table(self.definition)

    def reverse(self, s):
        return s.without_table(self.table)

    def run(self, engine):
        if self.select is None:
            df = engine.spark.createDataFrame([], self.definition.struct)
        else:
            rows = engine.query(self.select)
            df = rows.select(*(F.col(f"`{a}`").cast(f.dataType).alias(f.name) for a, f in zip(rows.columns, self.definition.struct, strict=True)))
        engine.put(self.table, df)


@dataclass(frozen=True)
class ReplaceTable(AddTable):
    """New rows, from a select that may read the old ones, in a table of the same definition."""

    def apply(self, s):
        if s.table(self.table) != self.definition:
            raise EvolutionError(f"table {self.table} has another definition")
        return super().apply(s.without_table(self.table))

    def reverse(self, s):
        return s


@dataclass(frozen=True)
class RemoveTable(Change):
    definition: Table

    @property
    def table(self):
        return self.definition.name

    def apply(self, s):
        s.table(self.table)
        return s.without_table(self.table)

    def reverse(self, s):
        return s.with_table(self.definition)

    def run(self, engine):
        engine.drop(self.table)


@dataclass(frozen=True)
class RenameTable(Change):
    table: str
    new_name: str

    def _rename(self, s, a, b):
        if s.has_table(b):
            raise EvolutionError(f"table {b} is there already")
        t = s.table(a)
        return s.without_table(a).with_table(replace(t, name=b))

    def apply(self, s):
        return self._rename(s, self.table, self.new_name)

    def reverse(self, s):
        return self._rename(s, self.new_name, self.table)

    def run(self, engine):
        engine.rename(self.table, self.new_name)

    @property
    def modifies(self):
        return {self.table.lower(), self.new_name.lower()}


@dataclass(frozen=True)
class ChangeIndex(Change):
    """Adds (old None), removes (new None), changes or renames an index. A unique one is checked on the rows."""

    table: str
    old: Index | None
    new: Index | None

    def _change(self, s, a, b):
        t = s.table(self.table)
        names = {i.name.lower() for i in t.index_list}
        if a is not None and a.name.lower() not in names:
            raise EvolutionError(f"no index {a.name} on {self.table}")
        if b is not None and b.name.lower() in names - ({a.name.lower()} if a else set()):
            raise EvolutionError(f"index {b.name} is there already")
        return s.with_table(replace(t, index_list=(*t.index_list, b) if a is None else _swap(t.index_list, a.name, b)))

    def apply(self, s):
        return self._change(s, self.old, self.new)

    def reverse(self, s):
        return self._change(s, self.new, self.old)

    def run(self, engine):
        if self.new is not None and self.new.is_unique and engine.has_table(self.table):
            require_unique(engine.table(self.table), self.new.column_names)


@dataclass(frozen=True)
class ChangePrimaryKey(Change):
    table: str
    old: tuple[str, ...]
    new: tuple[str, ...]

    def _change(self, s, a, b):
        t = s.table(self.table)
        if tuple(x.lower() for x in t.primary_key) != tuple(x.lower() for x in a):
            raise EvolutionError(f"primary key of {self.table} isn't {a}")
        keys = {x.lower() for x in b}
        return s.with_table(replace(t, column_list=tuple(replace(c, is_primary_key=c.name.lower() in keys) for c in t.column_list)))

    def apply(self, s):
        return self._change(s, self.old, self.new)

    def reverse(self, s):
        return self._change(s, self.new, self.old)

    def run(self, engine):
        if self.new and engine.has_table(self.table):
            df = engine.table(self.table)
            require_unique(df, self.new)
            if not df.where(" or ".join(f"`{c}` is null" for c in self.new)).isEmpty():
                raise EvolutionError(f"the new key of {self.table} has nulls")


@dataclass(frozen=True)
class ChangeSequence(Change):
    sequence: Sequence
    add: bool

    @property
    def table(self):
        return f"sequence:{self.sequence.name}"

    def _set(self, s, there):
        others = tuple(x for x in s.sequences if x.name.lower() != self.sequence.name.lower())
        if there == (len(others) < len(s.sequences)):
            raise EvolutionError(f"sequence {self.sequence.name} is {'already' if there else 'not'} there")
        return replace(s, sequences=(*others, self.sequence) if there else others)

    def apply(self, s):
        return self._set(s, self.add)

    def reverse(self, s):
        return self._set(s, not self.add)

    def run(self, engine):
        engine.sequences.create(self.sequence) if self.add else engine.sequences.drop(self.sequence.name)


@dataclass(frozen=True)
class AnalyseTable(Change):
    table: str

    def apply(self, s):
        s.table(self.table)
        return s

    reverse = apply

    def run(self, engine):
        """Snapshots carry their own parquet statistics; there is nothing to refresh."""


@dataclass(frozen=True)
class DataChange(Change):
    """A data change; schemas stay as they are."""

    statement: object

    @property
    def table(self):
        return getattr(self.statement, "table", "")

    def apply(self, s):
        return s

    reverse = apply

    def run(self, engine):
        engine.execute(self.statement)


def require_unique(df: DataFrame, columns) -> None:
    if not df.groupBy(*columns).count().where("count > 1").isEmpty():
        raise EvolutionError(f"values of {tuple(columns)} repeat")


class Recorder:
    """What a step writes its changes to."""

    def __init__(self, start: Schema):
        self.start, self.changes = start, []

    @property
    def schema(self) -> Schema:
        s = self.start
        for c in self.changes:
            s = c.apply(s)
        return s

    def do(self, c: Change) -> None:
        c.apply(self.schema)
        self.changes.append(c)

    def add_table(self, t: Table) -> None:
        self.do(AddTable(t))

    def add_table_from(self, t: Table, select) -> None:
        self.do(AddTable(t, select))

    def replace_table_from(self, name: str, select) -> None:
        self.do(ReplaceTable(self.schema.table(name), select))

    def remove_table(self, name: str) -> None:
        self.do(RemoveTable(self.schema.table(name)))

    def rename_table(self, old: str, new: str) -> None:
        self.do(RenameTable(old, new))

    def add_column(self, t: str, c: Column, value=None) -> None:
        self.do(AddColumn(t, c, value))

    def change_column(self, t: str, old: Column, new: Column) -> None:
        self.do(ChangeColumn(t, old, new))

    def remove_column(self, t: str, name: str) -> None:
        self.do(RemoveColumn(t, self.schema.table(t).column(name)))

    def add_index(self, t: str, i: Index) -> None:
        self.do(ChangeIndex(t, None, i))

    def remove_index(self, t: str, i: Index) -> None:
        self.do(ChangeIndex(t, i, None))

    def change_index(self, t: str, old: Index, new: Index) -> None:
        self.do(ChangeIndex(t, old, new))

    def rename_index(self, t: str, old: str, new: str) -> None:
        i = next(x for x in self.schema.table(t).index_list if x.name.lower() == old.lower())
        self.do(ChangeIndex(t, i, replace(i, name=new)))

    def change_primary_key(self, t: str, old: tuple[str, ...], new: tuple[str, ...]) -> None:
        self.do(ChangePrimaryKey(t, old, new))

    def correct_primary_key(self, t: str, new: tuple[str, ...]) -> None:
        self.do(ChangePrimaryKey(t, self.schema.table(t).primary_key, new))

    def add_primary_key(self, t: str, new: tuple[str, ...]) -> None:
        self.do(ChangePrimaryKey(t, (), new))

    def remove_primary_key(self, t: str) -> None:
        self.do(ChangePrimaryKey(t, self.schema.table(t).primary_key, ()))

    def add_sequence(self, s: Sequence) -> None:
        self.do(ChangeSequence(s, True))

    def remove_sequence(self, s: Sequence) -> None:
        self.do(ChangeSequence(s, False))

    def analyse_table(self, t: str) -> None:
        self.do(AnalyseTable(t))

    def execute(self, statement) -> None:
        self.do(DataChange(statement))


@dataclass(frozen=True)
class Step:
    """An upgrade step: identity, place in the order, and what it does."""

    uuid: str
    sequence: int
    description: str
    execute: Callable[[Recorder], None]
    version: str = ""
    only_with: str | None = None
    exclusive: bool = False
    reads: tuple[str, ...] = ()


AUDIT = table("UpgradeAudit").columns(column("upgradeUUID", DataType.STRING, 100).primary_key(), column("description", DataType.STRING, 200).nullable(), column("appliedTime", DataType.DECIMAL, 14).nullable())


def pending(steps: list[Step], applied: dict[str, str]) -> list[Step]:
    """Steps that the audit (uuid to description) lacks, in order; one that only goes with another waits for that."""
    by = {s.uuid: s for s in steps}
    if len(by) != len(steps):
        raise EvolutionError("two steps have the same uuid")
    known = {d: u for u, d in applied.items()}
    open_ = {s.uuid for s in steps if s.uuid not in applied}
    for s in steps:
        if s.uuid in open_ and known.get(s.description, s.uuid) != s.uuid:
            raise EvolutionError(f"step [{s.description}] was applied under another uuid")

    def due(s: Step, seen: frozenset = frozenset()) -> bool:
        if s.uuid not in open_:
            return False
        if s.only_with is None or s.uuid in seen:
            return True
        if s.only_with not in by:
            raise EvolutionError(f"step {s.uuid} goes with an unknown one")
        return due(by[s.only_with], seen | {s.uuid})

    return sorted((s for s in steps if due(s)), key=lambda s: (s.sequence, s.uuid))


def find_path(source: Schema, target: Schema, steps: list[Step], applied: dict[str, str], ignore_extra: tuple[str, ...] = ()) -> list[tuple[Step, list[Change]]]:
    """The changes that lead from source to target; forward they must give the target, back again the source."""
    path, s = [], source
    for step in pending(steps, applied):
        r = Recorder(s)
        step.execute(r)
        path.append((step, r.changes))
        s = r.schema
    faults = differences(s, target, ignore_extra)
    if faults:
        raise EvolutionError("the steps don't lead to the target:\n" + "\n".join(faults))
    for _, changes in reversed(path):
        for c in reversed(changes):
            s = c.reverse(s)
    faults = differences(s, source, ignore_extra)
    if faults:
        raise EvolutionError("the steps don't lead back:\n" + "\n".join(faults))
    return path


class Status(Enum):
    NONE = "NONE"
    DATA_TRANSFER_REQUIRED = "DATA_TRANSFER_REQUIRED"
    DATA_TRANSFER_IN_PROGRESS = "DATA_TRANSFER_IN_PROGRESS"
    IN_PROGRESS = "IN_PROGRESS"
    COMPLETED = "COMPLETED"


class Upgrade:
    """Upgrades an engine's tables to a target schema."""

    def __init__(self, engine, target: Schema, steps: list[Step], views=()):
        self.engine, self.target, self.steps, self.views = engine, target, steps, views
        self.status, self._lock = Status.NONE, threading.Lock()

    def applied(self) -> dict[str, str]:
        if not self.engine.has_table(AUDIT.name):
            return {}
        return {r["upgradeUUID"]: r["description"] for r in self.engine.table(AUDIT.name).collect()}

    def perform(self, graph: bool = False, threads: int = 4) -> list[str]:
        """Runs what is pending and returns the steps' uuids. Only one upgrade runs at a time."""
        with self._lock:
            if self.status is Status.IN_PROGRESS:
                raise EvolutionError("an upgrade is running")
            self.status = Status.IN_PROGRESS
        try:
            before = self.applied()
            path = find_path(self.engine.schema, self.target, self.steps, before)
            if len(self.applied()) != len(before):
                raise EvolutionError("another upgrade ran meanwhile")
            if graph:
                run_graph(path, self._run, threads)
            else:
                for step, changes in path:
                    self._run(step, changes)
            self.engine.schema = self.target
            changed_views(self.engine, self.views)
            self.status = Status.COMPLETED
            return [s.uuid for s, _ in path]
        except BaseException:
            self.status = Status.NONE
            raise

    def _run(self, step: Step, changes: list[Change]) -> None:
        for c in changes:
            c.run(self.engine)
        with self.engine.lock:
            audit(self.engine, [step])


def audit(engine, steps: list[Step]) -> None:
    """A row a step, with the time as a number of fourteen digits."""
    from decimal import Decimal

    now = Decimal(dt.datetime.now(dt.UTC).strftime("%Y%m%d%H%M%S"))
    rows = engine.spark.createDataFrame([(s.uuid, s.description, now) for s in steps], AUDIT.struct)
    have = engine.table(AUDIT.name) if engine.has_table(AUDIT.name) else None
    engine.put(AUDIT.name, rows if have is None else have.unionByName(rows))


def deploy(engine, target: Schema, steps: list[Step], views=()) -> None:
    """All tables from nothing; every step counts as applied."""
    for t in target.tables:
        engine.put(t.name, engine.spark.createDataFrame([], t.struct))
    for s in target.sequences:
        engine.sequences.create(s)
    engine.schema = target
    if steps:
        audit(engine, steps)
    changed_views(engine, views)


def view_hash(v) -> str:
    return hashlib.md5(re.sub(r" at 0x[0-9a-f]+", "", repr(v.select)).encode()).hexdigest()  # noqa: S324


def changed_views(engine, views) -> list[str]:
    """Takes up views whose definition changed, and those that depend on them; drops views that are gone."""
    hashes = getattr(engine, "view_hashes", {})
    fresh = {v.name.lower(): view_hash(v) for v in views}
    changed = {n for n, h in fresh.items() if hashes.get(n) != h}
    grown = True
    while grown:
        more = {v.name.lower() for v in views if v.name.lower() not in changed and any(d.lower() in changed for d in v.dependencies)}
        grown = bool(more)
        changed |= more
    for n in set(engine.views) - set(fresh):
        engine.drop(n)
    engine.deploy_views(views)
    engine.view_hashes = fresh
    return sorted(changed)


def graph_edges(path: list[tuple[Step, list[Change]]]) -> list[set[int]]:
    """For each step the earlier ones it has to wait for: shared writes, reads of writes, writes of reads, and exclusive steps."""
    writes = [set().union(*(c.modifies for c in changes), set()) for _, changes in path]
    reads = [{r.lower() for r in s.reads} for s, _ in path]
    out = []
    for k, (s, _) in enumerate(path):
        out.append({j for j in range(k) if s.exclusive or path[j][0].exclusive or writes[k] & writes[j] or writes[k] & reads[j] or reads[k] & writes[j]})
    return out


def run_graph(path: list[tuple[Step, list[Change]]], run: Callable[[Step, list[Change]], None], threads: int) -> None:
    """Steps side by side as far as their tables allow. The first failure stops new ones."""
    needs, done, started, running = graph_edges(path), set(), set(), {}
    with ThreadPoolExecutor(threads) as pool:
        while len(done) < len(path):
            for k in range(len(path)):
                if k not in started and needs[k] <= done:
                    started.add(k)
                    running[pool.submit(run, *path[k])] = k
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                f.result()
                done.add(running.pop(f))


def describe(path: list[tuple[Step, list[Change]]]) -> list[str]:
    """The path in words, a line a change."""
    words = lambda c: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", type(c).__name__).lower()
    return [f"{s.sequence} {s.description}: {words(c)} {c.table}" for s, changes in path for c in changes]
