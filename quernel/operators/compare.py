"""Comparison of tables, data sets and query results: full joins on the key, differences as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.sources.datasets import Producer
from quernel.sources.numbering import consecutive
from quernel.sources.schema import Table

#: Columns that a table diff doesn't look at.
EXCLUDED = ("id", "version")
_FAMILIES = {"tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "number", "double": "number", "date": "date", "timestamp": "date", "string": "string", "boolean": "boolean", "binary": "binary"}


def _family(t: T.DataType) -> str:
    name = t.simpleString()
    return "number" if name.startswith("decimal") else _FAMILIES.get(name, name)


def _shown(df: DataFrame, name: str, scale: int | None = None):
    """A value as comparable text: numbers without trailing zeros, the empty string as null."""
    t = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if _family(t) == "number":
        c = c.cast(T.DecimalType(38, 10 if scale is None else scale)) if scale is not None or isinstance(t, T.DecimalType | T.IntegralType) else c
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.nullif(F.base64(c) if _family(t) == "binary" else c.cast("string"), F.lit(""))


def table_diff(left: DataFrame, right: DataFrame, t: Table, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(key, column_name, left_value, right_value, kind) of every difference; kind is MISMATCH, MISSING_LEFT or MISSING_RIGHT.

    Without a usable key rows are paired by position. Numbers are rounded half up to the column's scale, empty
    strings count as null.
    """
    skip = {e.lower() for e in excluded}
    columns = [c for c in t.column_list if c.name.lower() not in skip]
    keys = [c.name for c in columns if c.is_primary_key]
    if not keys:
        left, right = consecutive(left, "__row", 0), consecutive(right, "__row", 0)
    side = lambda df: df.select(*([_shown(df, k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.col("__row").cast("string").alias("k0")]), *(_shown(df, c.name, c.scale if c.width else None).alias(f"v{i}") for i, c in enumerate(columns)), F.lit(True).alias("here"))
    return _differences(side(left), side(right), len(keys) or 1, [c.name for c in columns], {k.lower() for k in keys})


def _differences(a: DataFrame, b: DataFrame, n_keys: int, names: list[str], keys: set[str]) -> DataFrame:
    """Rows of a and b side by side by keys k0, k1, ...; a row for each unequal value that isn't part of the key."""
    on = None
    for i in range(n_keys):
        c = F.col(f"a.k{i}") == F.col(f"b.k{i}")
        on = c if on is None else on & c
    both = a.alias("a").join(b.alias("b"), on, "full")
    kind = F.when(F.col("a.here").isNull(), "MISSING_LEFT").when(F.col("b.here").isNull(), "MISSING_RIGHT").otherwise("MISMATCH")
    key = F.concat_ws("|", *(F.coalesce(f"a.k{i}", f"b.k{i}") for i in range(n_keys)))
    cells = [F.struct(F.lit(n).alias("column_name"), F.col(f"a.v{i}").alias("left_value"), F.col(f"b.v{i}").alias("right_value")) for i, n in enumerate(names) if n.lower() not in keys]
    if not cells:
        cells = [F.struct(F.lit("").alias("column_name"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"))]
    rows = both.select(key.alias("key"), kind.alias("kind"), F.explode(F.array(*cells)).alias("c"))
    return rows.where((F.col("kind") != "MISMATCH") | ~F.col("c.left_value").eqNullSafe(F.col("c.right_value"))).select("key", "c.column_name", "c.left_value", "c.right_value", "kind")


def dataset_diff(left: Producer, right: Producer, excluded: tuple[str, ...] = EXCLUDED) -> list[str]:
    """What sets two data sets apart: tables that one lacks, and the number of differences in common ones."""
    a, b = ({t.name.lower(): t for t in p.schema().tables} for p in (left, right))
    out = [f"table [{n}] is only in the {'first' if n in a else 'second'} data set" for n in sorted(a.keys() ^ b.keys())]
    for n in sorted(a.keys() & b.keys()):
        count = table_diff(left.records(n), right.records(n), a[n], excluded).count()
        if count:
            out.append(f"table [{n}] has {count} differences")
    return out


NON_EMPTY_RESULT = "NON_EMPTY_RESULT"
NON_ZERO_RESULT = "NON_ZERO_RESULT"


def result_diff(left: DataFrame, right: DataFrame, keys: tuple[int, ...] = (), validations: tuple[str, ...] = ()) -> DataFrame:
    """Differences of two query results by key columns (counted from 1): a row for each non-key column.

    Columns pair by position and must be of one family of types. Without keys both sides have a row at most.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError("results have different numbers of columns")
    for x, y in zip(left.schema, right.schema, strict=True):
        if _family(x.dataType) != _family(y.dataType):
            raise ValueError(f"columns {x.name} and {y.name} are of different kinds")
    right = right.toDF(*left.columns)
    names = [left.columns[k - 1] for k in keys]
    if not keys and max(left.limit(2).count(), right.limit(2).count()) > 1:
        raise ValueError("without keys results have one row at most")
    for df in (left, right):
        if NON_EMPTY_RESULT in validations and df.isEmpty():
            raise ValueError("a result is empty")
        if NON_ZERO_RESULT in validations and df.first() is not None and not df.first()[0]:
            raise ValueError("a result is zero")
        for n in names:
            if not df.where(F.col(f"`{n}`").isNull()).isEmpty():
                raise ValueError(f"key column {n} has a null")

    def shown(df: DataFrame, n: str):
        c = _shown(df, n)
        return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "") if _family(df.schema[n].dataType) == "number" else c

    side = lambda df: df.select(*([shown(df, k).alias(f"k{i}") for i, k in enumerate(names)] or [F.lit("").alias("k0")]), *(shown(df, n).alias(f"v{i}") for i, n in enumerate(df.columns)), F.lit(True).alias("here"))
    return _differences(side(left), side(right), len(names) or 1, left.columns, {n.lower() for n in names})


def ordered(df: DataFrame) -> DataFrame:
    """Records in the order of their columns."""
    return df.orderBy(*df.columns)


def joined(df: DataFrame, delimiter: str = ",", null: str = "") -> DataFrame:
    """Each record as one string."""
    return df.select(F.concat_ws(delimiter, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns)).alias("record"))
