"""Data sets: a schema and a DataFrame a table; producers, consumers, adapters and connectors between them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.sources.schema import DataType, Schema, Table, column, schema, table


class Producer:
    """Gives a schema and each table's records."""

    def schema(self) -> Schema:
        raise NotImplementedError

    def records(self, name: str) -> DataFrame:
        raise NotImplementedError

    def open(self) -> None: ...

    def close(self) -> None: ...


@dataclass
class Frames(Producer):
    """Tables in memory or anywhere else that DataFrames come from."""

    frames: dict[str, DataFrame]
    declared: Schema | None = None

    def schema(self) -> Schema:
        return self.declared or schema(*(table_of(n, df) for n, df in self.frames.items()))

    def records(self, name: str) -> DataFrame:
        return next(df for n, df in self.frames.items() if n.lower() == name.lower())


def data_type(spark_name: str) -> tuple[DataType, int, int]:
    """The type, width and scale that a Spark type is read as."""
    if spark_name.startswith("decimal"):
        w, s = spark_name[8:-1].split(",")
        return DataType.DECIMAL, int(w), int(s)
    plain = {"boolean": DataType.BOOLEAN, "date": DataType.DATE, "bigint": DataType.BIG_INTEGER, "int": DataType.INTEGER, "smallint": DataType.INTEGER, "tinyint": DataType.INTEGER, "binary": DataType.BLOB}
    if spark_name in plain:
        return plain[spark_name], 0, 0
    if spark_name in ("double", "float"):
        return DataType.DECIMAL, 38, 18
    return DataType.STRING, 255, 0


def table_of(name: str, df: DataFrame) -> Table:
    """What a DataFrame's schema says of a table; the model's own metadata wins."""
    out = []
    for f in df.schema.fields:
        m = f.metadata
        if "quernel.type" in m:
            c = column(f.name, DataType(m["quernel.type"]), m["quernel.width"], m["quernel.scale"])
            c = c.primary_key() if m["quernel.pk"] else c
            c = c.default_value(m["quernel.default"]) if m["quernel.default"] else c
            c = c.auto_numbered(m["quernel.auto"]) if m["quernel.auto"] >= 0 else c
        else:
            c = column(f.name, *data_type(f.dataType.simpleString()))
        out.append(c.nullable() if f.nullable and not c.is_primary_key else c)
    return table(name).columns(*out)


class ParquetFolder(Producer):
    """A folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, names: Iterable[str]):
        self.spark, self.folder, self.names = spark, folder, list(names)

    def schema(self) -> Schema:
        return schema(*(table_of(n, self.records(n)) for n in self.names))

    def records(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Jdbc(Producer):
    """Tables of a database by Spark's JDBC source; its driver has to be on the class path."""

    def __init__(self, spark: SparkSession, url: str, names: Iterable[str], **options: str):
        self.spark, self.url, self.names, self.options = spark, url, list(names), {"fetchsize": "2000"} | options

    def schema(self) -> Schema:
        return schema(*(table_of(n, self.records(n)) for n in self.names))

    def records(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()


#: What a JDBC url begins with, by database.
DATABASES = {"H2": "jdbc:h2:", "MY_SQL": "jdbc:mysql:", "ORACLE": "jdbc:oracle:", "PGSQL": "jdbc:postgresql:", "SQL_SERVER": "jdbc:sqlserver:"}


def database_of(url: str) -> str:
    found = [k for k, v in DATABASES.items() if url.lower().startswith(v)]
    if not found:
        raise ValueError(f"no database known for {url}")
    return found[0]


class SqlQuery(Producer):
    """One named table, the result of a SQL text."""

    def __init__(self, spark: SparkSession, name: str, query: str):
        self.spark, self.name, self.query = spark, name, query

    def schema(self) -> Schema:
        return schema(table_of(self.name, self.records(self.name)))

    def records(self, name: str) -> DataFrame:
        return self.spark.sql(self.query)


class Filtered(Producer):
    """Only some of a producer's tables."""

    def __init__(self, inner: Producer, names: Iterable[str] | Callable[[str], bool]):
        kept = None if callable(names) else {n.lower() for n in names}
        self.inner, self.keep = inner, names if kept is None else lambda n: n.lower() in kept

    def schema(self) -> Schema:
        return schema(*(t for t in self.inner.schema().tables if self.keep(t.name)))

    def records(self, name: str) -> DataFrame:
        if not self.keep(name):
            raise KeyError(f"no table {name}")
        return self.inner.records(name)


class WithMetadata(Producer):
    """One producer's records under another's schema: its columns, in its order and types."""

    def __init__(self, records: Producer, metadata: Schema):
        self.inner, self.metadata = records, metadata

    def schema(self) -> Schema:
        return self.metadata

    def records(self, name: str) -> DataFrame:
        df = self.inner.records(name)
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.metadata.table(name).struct))


def masked(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df with null in some columns."""
    hidden = {c.lower() for c in columns}
    return df.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name.lower() in hidden else F.col(f"`{f.name}`") for f in df.schema))


class Consumer:
    """Takes tables one by one."""

    def open(self) -> None: ...

    def table(self, t: Table, df: DataFrame) -> None:
        raise NotImplementedError

    def close(self, complete: bool) -> None: ...


class Inserting(Consumer):
    """Replaces an engine's tables by what comes."""

    def __init__(self, engine):
        self.engine = engine

    def table(self, t: Table, df: DataFrame) -> None:
        self.engine.put(t.name, df)


class Merging(Consumer):
    """Upserts by primary key, where two incoming rows with one key are an error; tables without a key are appended to."""

    def __init__(self, engine):
        self.engine = engine

    def table(self, t: Table, df: DataFrame) -> None:
        if not self.engine.has_table(t.name):
            self.engine.put(t.name, df)
            return
        old, keys = self.engine.table(t.name), list(t.primary_key)
        if not keys:
            self.engine.put(t.name, old.unionByName(df))
            return
        twice = F.count(F.lit(1)).over(Window.partitionBy(*(F.col(f"`{k}`") for k in keys))) > 1
        df = df.withColumn("__once", F.when(twice, F.raise_error(F.lit("two input rows for one key")).cast("boolean")).otherwise(F.lit(True))).filter("__once").drop("__once")
        kept = old.join(df.select(*keys), keys, "left_anti").select(*old.columns)
        self.engine.put(t.name, kept.unionByName(df.select(*old.columns)))


class SchemaAdapting(Consumer):
    """Before a table comes, one that has another shape is dropped; at the end so are views and tables that didn't come."""

    def __init__(self, engine, inner: Consumer):
        self.engine, self.inner, self.seen = engine, inner, set()

    def open(self) -> None:
        self.engine.views.clear()
        self.inner.open()

    def table(self, t: Table, df: DataFrame) -> None:
        self.seen.add(t.name.lower())
        have = self.engine.table(t.name) if self.engine.has_table(t.name) else None
        if have is not None and [(f.name.lower(), f.dataType) for f in have.schema] != [(f.name.lower(), f.dataType) for f in df.schema]:
            self.engine.drop(t.name)
        self.inner.table(t, df)

    def close(self, complete: bool) -> None:
        if complete:
            for n in self.engine.table_names() - self.seen:
                self.engine.drop(n)
        self.inner.close(complete)


class ParquetSink(Consumer):
    """A parquet table each."""

    def __init__(self, folder: str):
        self.folder = folder

    def table(self, t: Table, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{t.name}.parquet")


def connect(producer: Producer, consumer: Consumer, threads: int = 1) -> None:
    """Every table of the producer to the consumer; with several threads tables run side by side.

    The consumer learns at the end whether all tables went through.
    """
    producer.open()
    consumer.open()
    done = False
    try:
        one = lambda t: consumer.table(t, producer.records(t.name))
        tables = producer.schema().tables
        if threads == 1:
            for t in tables:
                one(t)
        else:
            with ThreadPoolExecutor(threads) as pool:
                list(pool.map(one, tables))
        done = True
    finally:
        consumer.close(done)
        producer.close()


def default_threads() -> int:
    return max(1, min(8, (os.cpu_count() or 2) // 2))
