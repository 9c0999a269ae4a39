"""Data changes as functions from the old snapshot to the new one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.plans.expr import DslError, drawn
from quernel.plans.lower import Lowering
from quernel.plans.statements import Delete, Insert, Merge, Select, TableRef, Truncate, Update
from quernel.sources.schema import DataType, Table


def _default(f: T.StructField, known: Table | None, given: dict[str, Column]) -> Column:
    """A missing column's value: the statement's default, the declared one, or else one by type."""
    if f.name.lower() in given:
        return given[f.name.lower()]
    if known is not None and known.has_column(f.name):
        c = known.column(f.name)
        if c.default is not None:
            return F.lit(c.default or None)
        if c.type_ is DataType.BOOLEAN:
            return F.lit(False)
        if c.type_ in (DataType.DECIMAL, DataType.INTEGER, DataType.BIG_INTEGER):
            return F.lit(0)
        return F.lit(None)
    return F.lit(0) if f.name.lower() == "version" else F.lit(None)


def _numbered(new: DataFrame, old: DataFrame, column: str, start: int) -> DataFrame:
    """New rows' numbers follow the largest of the old, or begin at start.

    Numbers are dealt by partition: each partition's first number is what the partitions before it hold, so no
    task sees all rows. The counts, one a partition, go through the driver.
    """
    from quernel.sources.numbering import consecutive

    first = old.agg(F.max(column)).first()[0]
    first = start if first is None else max(start, first + 1)
    return consecutive(new.drop(column), column, first)


def insert(low: Lowering, old: DataFrame, s: Insert, known: Table | None, batch: list[dict] | None = None) -> DataFrame:
    """old with the new rows; with ``batch``, a parameterised insert's, one row for each set of parameters."""
    scope = replace(low.scope({}), one_row=True)
    fill = known is not None and not any(c.auto_from is not None for c in known.column_list) or s.defaults is not None
    if isinstance(s.source, Select):
        new = low.select(s.source)
        if s.targets:
            if len(new.columns) != len(s.targets):
                raise DslError("as many fields as targets are needed")
            new = new.toDF(*s.targets)
        fill = s.defaults is not None
    elif s.source is not None:
        new = low.resolve(TableRef(s.source))
        have = {c.lower() for c in new.columns}
        new = new.select(*(F.col(f"`{f.name}`") for f in old.schema if f.name.lower() in have))
    elif s.rows:
        one = low.spark.range(1)
        new = None
        for row in s.rows:
            part = one.select(*(v.lower(scope).alias(v.name) for v in row))
            new = part if new is None else new.unionByName(part, allowMissingColumns=True)
    elif batch is not None:
        kinds = {f.name.lower(): f.dataType for f in old.schema}
        names = s.targets or tuple(f.name for f in old.schema if any(f.name in b for b in batch))
        new = low.spark.createDataFrame([tuple(b.get(n) for n in names) for b in batch], T.StructType([T.StructField(n, kinds[n.lower()]) for n in names]))
    else:
        names = s.targets or tuple(old.columns)
        new = low.spark.range(1).select(*(F.lit(low.parameters.get(n)).alias(n) for n in names))
    have = {c.lower() for c in new.columns}
    auto = next((c for c in known.column_list if c.auto_from is not None), None) if known else None
    number = (auto.name, auto.auto_from) if auto else ("id", 1) if "id" in {c.lower() for c in old.columns} else None
    if number and number[0].lower() not in have:
        new = _numbered(new, old, *number)
        have.add(number[0].lower())
    asked = [a for a in s.defaults or () if a.name.lower() not in have]
    new, dealt = low.dealt(new, drawn(*asked))
    given = {a.name.lower(): a.lower(replace(low.scope({}), dealt=dealt)) for a in asked}
    out = []
    for f in old.schema:
        if f.name.lower() in have:
            value = F.col(f"`{f.name}`")
        else:
            value = _default(f, known, given) if fill or f.name.lower() == "version" else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return old.union(new.select(*out))


def _tables(df: DataFrame, *names: str) -> dict[str, set[str]]:
    return {n.lower(): {c.lower() for c in df.columns} for n in names}


def update(low: Lowering, old: DataFrame, s: Update, known: Table | None) -> DataFrame:
    """All values at once from the rows as they were; rows whose condition is unknown stay."""
    df = old.alias(s.table)
    scope = low.scope(_tables(old, s.table))
    sets = {a.name.lower(): a for a in s.sets}
    unknown = sets.keys() - {c.lower() for c in old.columns}
    if unknown:
        raise DslError(f"no columns {sorted(unknown)}")
    hit = None if s.criterion is None else s.criterion.lower(scope)
    names = drawn(*s.sets)
    if names:  # only rows that are hit use up numbers
        marked = df.withColumn("__hit", F.lit(True) if hit is None else F.coalesce(hit, F.lit(False)))
        rows, dealt = low.dealt(marked.filter("__hit").drop("__hit"), names)
        rest = None if hit is None else marked.filter("not __hit").drop("__hit")
        df, scope, hit = rows.alias(s.table), replace(scope, dealt=dealt), None
    out = []
    for f in old.schema:
        c = F.col(f"`{s.table}`.`{f.name}`")
        if f.name.lower() in sets:
            value = sets[f.name.lower()].lower(scope).cast(f.dataType)
            c = value if hit is None else F.when(hit, value).otherwise(c)
        out.append(c.alias(f.name))
    changed = df.select(*out)
    return changed.unionByName(rest) if names and rest is not None else changed


def delete(low: Lowering, old: DataFrame, s: Delete, known: Table | None) -> DataFrame:
    """Without the rows that the condition holds for; with a limit at most so many rows go, whichever."""
    df = old.alias(s.table)
    hit = F.lit(True) if s.criterion is None else F.coalesce(s.criterion.lower(low.scope(_tables(old, s.table))), F.lit(False))
    if s.row_limit is None:
        return df.filter(~hit)
    from quernel.sources.numbering import consecutive

    marked = df.withColumn("__hit", hit)
    doomed = consecutive(marked.filter("__hit"), "__n", 1)
    return marked.filter("not __hit").drop("__hit").unionByName(doomed.filter(F.col("__n") > s.row_limit).drop("__hit", "__n"))


def truncate(low: Lowering, old: DataFrame, s: Truncate, known: Table | None) -> DataFrame:
    return low.spark.createDataFrame([], old.schema)


def merge(low: Lowering, old: DataFrame, s: Merge, known: Table | None) -> DataFrame:
    """One full join on the key: matched rows are updated, others kept or inserted.

    Keys match by plain equality, so a null key never does. Two input rows for one key are an error when the
    snapshot is computed.
    """
    if not s.keys or s.source is None:
        raise DslError("a merge needs a key and a source")
    source = low.select(s.source)
    names = {c.lower() for c in source.columns}
    keys = [k.lower() for k in s.keys]
    if not set(keys) <= names:
        raise DslError("the source needs all key fields")
    w = Window.partitionBy(*(F.col(k) for k in s.keys))
    has_key = ~F.greatest(*(F.col(k).isNull() for k in s.keys), F.lit(False))
    once = F.when(has_key & (F.count(F.lit(1)).over(w) > 1), F.raise_error(F.lit("two input rows for one key")).cast("boolean")).otherwise(F.lit(True))
    t, i = old.withColumn("__old", F.lit(True)).alias("existing"), source.withColumn("__new", once).alias("input")
    on = None
    for k in s.keys:
        c = F.col(f"existing.`{k}`") == F.col(f"input.`{k}`")
        on = c if on is None else on & c
    both = t.join(i, on, "full")
    scope = low.scope({"existing": {c.lower() for c in old.columns}, "input": names})
    overrides = {a.name.lower(): a for a in s.updating}
    matched = F.col("__old") & F.col("__new")
    allowed = matched if s.only_where_ is None else matched & s.only_where_.lower(scope)
    version = {"version"} - names
    out = []
    for f in old.schema:
        n = f.name.lower()
        mine = F.col(f"existing.`{f.name}`")
        theirs = F.col(f"input.`{f.name}`").cast(f.dataType) if n in names else (F.lit(0).cast(f.dataType) if n in version else F.lit(None).cast(f.dataType))
        new = overrides[n].lower(scope).cast(f.dataType) if n in overrides else theirs if n in names and n not in keys else mine
        out.append(F.when(F.col("__old").isNull(), theirs).when(allowed, new).otherwise(mine).alias(f.name))
    auto = next((c for c in known.column_list if c.auto_from is not None and c.name.lower() not in names), None) if known else None
    if auto is None:
        return both.select(*out)
    both = both.select(*out, F.col("__old").isNull().alias("__fresh"))
    fresh = _numbered(both.filter("__fresh").drop("__fresh"), old, auto.name, auto.auto_from)
    return both.filter("not __fresh").drop("__fresh").unionByName(fresh)
