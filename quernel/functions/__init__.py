"""The DSL's functions: each builds a field that lowers to built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quernel.plans.expr import ROW_NUMBER, Case, Function, RowNumber, case, when, wrap


def _f(name, build, *args, aggregate=False, windowed=False) -> Function:
    return Function(name, tuple(map(wrap, args)), build, aggregate, windowed)


# Aggregates
def count(x=None) -> Function:
    return _f("count", lambda *c: F.count(*(c or (F.lit(1),))), *([] if x is None else [x]), aggregate=True, windowed=True)


def count_distinct(x) -> Function:
    return _f("count_distinct", lambda c: F.count_distinct(c), x, aggregate=True)


def sum_(x) -> Function:
    return _f("sum", F.sum, x, aggregate=True, windowed=True)


def sum_distinct(x) -> Function:
    return _f("sum_distinct", F.sum_distinct, x, aggregate=True)


def average(x) -> Function:
    return _f("average", F.avg, x, aggregate=True, windowed=True)


def average_distinct(x) -> Function:
    # A distinct average is the distinct sum over the distinct count; both share one expansion of rows.
    return _f("average_distinct", lambda c: F.sum_distinct(c) / F.count_distinct(c), x, aggregate=True)


def min_(x) -> Function:
    return _f("min", F.min, x, aggregate=True, windowed=True)


def max_(x) -> Function:
    return _f("max", F.max, x, aggregate=True, windowed=True)


def some(x) -> Function:
    return _f("some", F.bool_or, x, aggregate=True)


def every(x) -> Function:
    return _f("every", F.bool_and, x, aggregate=True)


def row_number() -> Function:
    """Windowed it needs an order; by itself rows are numbered in no stated order."""
    return _f("row_number", F.row_number, windowed=True)


def any_row_number() -> Function:
    return RowNumber(ROW_NUMBER, (), lambda: F.row_number().over(Window.orderBy(F.lit(1))).cast("bigint"))


# Strings
def substring(x, start, length_) -> Function:
    return _f("substring", lambda c, s, n: F.substr(c, s.cast("int"), n.cast("int")), x, start, length_)


def trim(x) -> Function:
    return _f("trim", F.trim, x)


def left_trim(x) -> Function:
    return _f("left_trim", F.ltrim, x)


def right_trim(x) -> Function:
    return _f("right_trim", F.rtrim, x)


def left_pad(x, length_, pad=" ") -> Function:
    return _f("left_pad", lambda c, n, p: F.call_function("lpad", c.cast("string"), n.cast("int"), p), x, length_, pad)


def right_pad(x, length_, pad=" ") -> Function:
    return _f("right_pad", lambda c, n, p: F.call_function("rpad", c.cast("string"), n.cast("int"), p), x, length_, pad)


def lower_case(x) -> Function:
    return _f("lower_case", F.lower, x)


def upper_case(x) -> Function:
    return _f("upper_case", F.upper, x)


def length(x) -> Function:
    return _f("length", F.length, x)


def blob_length(x) -> Function:
    return _f("blob_length", F.octet_length, x)


def random_string(n) -> Function:
    return _f("random_string", lambda c: F.substr(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(c / 32)).cast("int")), lambda i: F.md5((F.rand() + i).cast("string"))), ""), F.lit(1), c.cast("int")), n)


# Nulls and comparison
def coalesce(*xs) -> Function:
    return _f("coalesce", F.coalesce, *xs)


def isnull(x, default) -> Function:
    return coalesce(x, default)


def greatest(*xs) -> Function:
    return _f("greatest", lambda *c: F.greatest(*c) if len(c) > 1 else c[0], *xs)


def least(*xs) -> Function:
    return _f("least", lambda *c: F.least(*c) if len(c) > 1 else c[0], *xs)


# Numbers
def mod(a, b) -> Function:
    return _f("mod", lambda x, y: x % y, a, b)


def round_(x, places=0) -> Function:
    return _f("round", lambda c: F.round(c, places), x)


def floor(x) -> Function:
    return _f("floor", F.floor, x)


def power(a, b) -> Function:
    return _f("power", F.pow, a, b)


def random() -> Function:
    return _f("random", F.rand)


# Dates
def yyyymmdd_to_date(x) -> Function:
    return _f("yyyymmdd_to_date", lambda c: F.to_date(c.cast("string"), "yyyyMMdd"), x)


def date_to_yyyymmdd(x) -> Function:
    return _f("date_to_yyyymmdd", lambda c: F.date_format(c, "yyyyMMdd").cast("decimal(8,0)"), x)


def date_to_yyyymmddhhmmss(x) -> Function:
    return _f("date_to_yyyymmddhhmmss", lambda c: F.date_format(c, "yyyyMMddHHmmss").cast("decimal(14,0)"), x)


def now() -> Function:
    """The current time in UTC."""
    return _f("now", lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def add_days(d, n) -> Function:
    return _f("add_days", lambda c, k: F.date_add(c.cast("date"), k.cast("int")), d, n)


def add_months(d, n) -> Function:
    return _f("add_months", lambda c, k: F.add_months(c.cast("date"), k.cast("int")), d, n)


def days_between(start, end) -> Function:
    return _f("days_between", lambda a, b: F.datediff(b.cast("date"), a.cast("date")), start, end)


def whole_months(a: Column, b: Column) -> Column:
    """Whole months from a to b; an end of month counts as reaching any day."""
    a, b = a.cast("date"), b.cast("date")
    apart = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    month_end = lambda d: d == F.last_day(d)
    back = F.when(F.dayofmonth(a) <= F.dayofmonth(b), 0).when(month_end(b), 0).otherwise(-1)
    forth = F.when(F.dayofmonth(b) <= F.dayofmonth(a), 0).when(month_end(a), 0).otherwise(1)
    return F.when(a == b, 0).when(b > a, apart + back).when(b < a, apart + forth)


def months_between(start, end) -> Function:
    return _f("months_between", whole_months, start, end)


def last_day_of_month(d) -> Function:
    return _f("last_day_of_month", F.last_day, d)


def cast_as_date(x) -> Function:
    return yyyymmdd_to_date(x)


def cast_as_date_null_if_zero(x) -> Case:
    return case(when(wrap(x).eq(0)).then(None)).otherwise(cast_as_date(x))


def cast_as_date_replace_if_zero(x, value) -> Case:
    return case(when(wrap(x).eq(0)).then(value)).otherwise(cast_as_date(x))


def cast_as_date_replace_if_null_or_zero(x, value) -> Case:
    return case(when(coalesce(x, 0).eq(0)).then(value)).otherwise(cast_as_date(x))
