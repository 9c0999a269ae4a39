"""The engine: a catalogue of named snapshots that queries read and data changes replace."""

from __future__ import annotations

import re
import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quernel.operators import dml
from quernel.plans.lower import Lowering
from quernel.plans.statements import Delete, Insert, Merge, Select, TableRef, Truncate, Update
from quernel.sources.schema import Counters, Schema, View


class Engine:
    """Names stand for DataFrames, whatever their case. A data change makes a new snapshot and then repoints the name.

    With ``folder`` each snapshot is written there as a new version before the name moves, so that a change never
    overwrites what it reads and a failed one leaves the old version in place; without it snapshots are plans.
    """

    def __init__(self, spark: SparkSession, schema: Schema | None = None, folder: str | None = None):
        self.spark, self.schema, self.folder = spark, schema or Schema(), folder
        self.frames: dict[str, DataFrame] = {}
        self.paths: dict[str, str] = {}
        self.views: dict[str, View] = {}
        self.sequences = Counters()
        for s in self.schema.sequences:
            self.sequences.create(s)
        self.lock = threading.RLock()

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, *names: str) -> Engine:
        """An engine over the parquet tables of a folder; a table is opened when it is first asked for."""
        e = cls(spark)
        e.paths = {n.lower(): f"{sf_dir}/{n}.parquet" for n in names}
        return e

    def put(self, name: str, df: DataFrame) -> None:
        """Makes df the snapshot of name."""
        with self.lock:
            if self.folder:
                path = f"{self.folder}/{name.lower()}/v-{uuid.uuid4().hex}"
                df.write.parquet(path)
                df = self.spark.read.schema(df.schema).parquet(path)
            self.frames[name.lower()] = df

    def drop(self, name: str) -> None:
        self.frames.pop(name.lower(), None)
        self.paths.pop(name.lower(), None)
        self.views.pop(name.lower(), None)

    def rename(self, old: str, new: str) -> None:
        self.frames[new.lower()] = self.table(old)
        self.drop(old)

    def has_table(self, name: str) -> bool:
        """Whether there is a snapshot of name, opened or not."""
        return name.lower() in self.frames or name.lower() in self.paths

    def table_names(self) -> set[str]:
        return {*self.frames, *self.paths}

    def table(self, name: str) -> DataFrame:
        return self.resolve(TableRef(name))

    def resolve(self, ref: TableRef) -> DataFrame:
        key = ref.name.lower()
        if ref.schema_name or ref.db_link:
            return self.spark.table(".".join(x for x in (ref.db_link, ref.schema_name, ref.name) if x))
        if key in self.paths and key not in self.frames:
            self.frames[key] = self.spark.read.parquet(self.paths[key])
        if key in self.frames:
            return self.frames[key]
        if key in self.views:
            return self.query(self.views[key].select)
        return self.spark.table(ref.name)

    def _lowering(self, parameters: dict[str, Any] | None) -> Lowering:
        return Lowering(self.spark, self.resolve, parameters, self.sequences)

    def query(self, statement: Select, parameters: dict[str, Any] | None = None, max_rows: int | None = None) -> DataFrame:
        df = self._lowering(parameters).select(statement)
        return df if max_rows is None else df.limit(max_rows)

    def changed(self, statement, parameters: dict[str, Any] | None = None) -> DataFrame:
        """The snapshot that a data change would make."""
        low = self._lowering(parameters)
        known = self.schema.table(statement.table) if self.schema.has_table(statement.table) else None
        apply = {Insert: dml.insert, Update: dml.update, Delete: dml.delete, Truncate: dml.truncate, Merge: dml.merge}[type(statement)]
        return apply(low, self.table(statement.table), statement, known)

    def execute(self, *statements, parameters: dict[str, Any] | None = None) -> None:
        """Runs data changes one after the other; strings are SQL over the engine's tables, with {name} for a table."""
        for s in statements:
            with self.lock:
                if isinstance(s, str):
                    self.sql(s)
                else:
                    self.put(s.table, self.changed(s, parameters))

    def execute_batch(self, statement, batch: list[dict[str, Any]]) -> None:
        """A statement once for each set of parameters; inserts of values go in as one snapshot."""
        with self.lock:
            if isinstance(statement, Insert) and not statement.source and not statement.rows:
                known = self.schema.table(statement.table) if self.schema.has_table(statement.table) else None
                self.put(statement.table, dml.insert(self._lowering(None), self.table(statement.table), statement, known, batch))
            else:
                for b in batch:
                    self.execute(statement, parameters=b)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which {name} stands for the engine's table of that name."""
        return self.spark.sql(text, **{n: self.table(n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def deploy_views(self, views) -> list[str]:
        """Takes up views in the order of what they depend on and returns their names; a circle is an error."""
        order = view_order(views)
        for v in order:
            self.views[v.name.lower()] = v
        return [v.name for v in order]


def view_order(views) -> list[View]:
    by = {v.name.lower(): v for v in views}
    done: list[View] = []
    state: dict[str, int] = {}

    def visit(v: View, path: tuple[str, ...]) -> None:
        key = v.name.lower()
        if state.get(key) == 2:
            return
        if state.get(key) == 1:
            raise ValueError(f"views depend on each other: {' > '.join((*path, v.name))}")
        state[key] = 1
        for d in v.dependencies:
            if d.lower() in by:
                visit(by[d.lower()], (*path, v.name))
        state[key] = 2
        done.append(v)

    for v in views:
        visit(v, ())
    return done
