"""The engine's queries over the star-schema tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel import functions as fn
from quernel.engine import Engine
from quernel.operators.compare import result_diff, table_diff
from quernel.plans.expr import and_, bracket, case, concat, exists, is_empty, is_not_empty, literal, math, native, native_function, not_, null_if_zero, null_literal, or_, parameter, when, window
from quernel.plans.expr import field_ as f
from quernel.plans.statements import delete, existing, incoming, insert, merge, select, select_distinct, select_first, table_ref, truncate, update
from quernel.sources.datasets import Frames, WithMetadata, masked
from quernel.sources.schema import DataType, column, schema, table, view

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    def keep(make):
        _REGISTRY[make.__name__] = (make, sql)
        return make

    return keep


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    make = _REGISTRY[name][0]

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, *TABLES)
        out = make(e)
        return out if isinstance(out, DataFrame) else e.query(out)

    return go


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: run(n) for n in _REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _REGISTRY.items() if sql}


def dec(e, scale: int = 2):
    """Sums of doubles depend on their order: as exact decimals they don't."""
    return e.cast(DataType.DECIMAL, 18, scale)


day = lambda e: e.cast(DataType.DATE)


# -- scans and projections ---------------------------------------------------------------------------


@query("""select l_returnflag as returnflag, l_linestatus as linestatus, sum(cast(l_quantity as decimal(18,2))) as sum_qty, sum(cast(l_extendedprice as decimal(18,2))) as sum_price,
 count(*) as n, min(l_discount) as least_discount from lineitem where cast(l_shipdate as date) <= date '1998-09-02' group by 1, 2""")
def flagship(e):
    return (
        select(f("l_returnflag").as_("returnflag"), f("l_linestatus").as_("linestatus"), fn.sum_(dec(f("l_quantity"))).as_("sum_qty"), fn.sum_(dec(f("l_extendedprice"))).as_("sum_price"), fn.count().as_("n"), fn.min_(f("l_discount")).as_("least_discount"))
        .from_("lineitem")
        .where(day(f("l_shipdate")).less_than_or_equal_to(day(literal("1998-09-02"))))
        .group_by(f("l_returnflag"), f("l_linestatus"))
        .order_by(f("returnflag"), f("linestatus"))
    )


@query("select * from nation")
def scan_all(e):
    return select().from_("nation")


@query("select l_orderkey, l_linenumber, l_quantity + l_tax * 2 as a, (l_quantity + 1) / 2 as b, l_quantity - (l_tax - l_discount) as c, 0 - l_quantity as d from lineitem")
def project_maths(e):
    return select(f("l_orderkey"), f("l_linenumber"), f("l_quantity").plus(f("l_tax")).multiply_by(2).as_("a"), bracket(f("l_quantity").plus(1)).divide_by(2).as_("b"), f("l_quantity").minus(f("l_tax").minus(f("l_discount"))).as_("c"), f("l_quantity").negated().as_("d")).from_("lineitem")


@query("select l_orderkey, l_linenumber, l_quantity + l_tax / (l_discount + 1) as a, l_quantity - l_tax - l_discount as b from lineitem")
def maths_precedence(e):
    return select(f("l_orderkey"), f("l_linenumber"), f("l_quantity").plus(f("l_tax")).divide_by(f("l_discount").plus(1)).as_("a"), math(math(f("l_quantity"), "-", f("l_tax")), "-", f("l_discount")).as_("b")).from_("lineitem")


@query("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 50000 then 'middle' else 'low' end as band from orders")
def case_when(e):
    return select(f("o_orderkey"), case(when(f("o_totalprice").greater_than(200000)).then("high"), when(f("o_totalprice").greater_than(50000)).then("middle")).otherwise("low").as_("band")).from_("orders")


@query("select o_orderkey, substr(cast(o_orderkey as varchar), 1, 3) as s, cast(o_totalprice as decimal(18,2)) as d, cast(o_orderdate as date) as o_day, cast(o_custkey as integer) as i from orders")
def cast_types(e):
    return select(f("o_orderkey"), f("o_orderkey").as_string(3).as_("s"), dec(f("o_totalprice")).as_("d"), day(f("o_orderdate")).as_("o_day"), f("o_custkey").cast(DataType.INTEGER).as_("i")).from_("orders")


@query("select n_nationkey, case when n_regionkey = 0 then null else n_regionkey end as r from nation")
def nullif_zero(e):
    return select(f("n_nationkey"), null_if_zero(f("n_regionkey")).as_("r")).from_("nation")


@query("select n_nationkey, n_name || '' || '-' || case when n_regionkey = 1 then '' else n_name end as s from nation")
def concat_nulls(e):
    return select(f("n_nationkey"), concat(f("n_name"), null_literal(), "-", case(when(f("n_regionkey").eq(1)).then("")).otherwise(f("n_name"))).as_("s")).from_("nation")


@query("select cast(1 as bigint) as a, 'x' as b, cast(null as varchar) as c")
def no_table_select(e):
    return select(literal(1).as_("a"), literal("x").as_("b"), literal("").as_("c"))


@query("select r_regionkey, cast(null as varchar) as e, true as t from region")
def empty_literal_null(e):
    return select(f("r_regionkey"), literal("").as_("e"), literal(True).as_("t")).from_("region")


@query("select cast(count(*) as bigint) as n from orders where o_custkey = 10")
def bind_parameter(e):
    return e.query(select(fn.count().as_("n")).from_("orders").where(f("o_custkey").eq(parameter("k", DataType.BIG_INTEGER))), {"k": 10})


@query("select n_nationkey, upper(n_name) as u, abs(n_nationkey - 10) as a from nation")
def native_escape(e):
    return select(f("n_nationkey"), native_function({"SPARK": "upper"}, f("n_name")).as_("u"), native(spark="abs(n_nationkey - 10)").as_("a")).from_("nation")


# -- conditions ---------------------------------------------------------------------------------------


@query("select o_orderkey from orders where o_totalprice >= 100000 and o_totalprice < 150000 and o_orderstatus <> 'F'")
def filter_compare(e):
    return select(f("o_orderkey")).from_("orders").where(f("o_totalprice").greater_than_or_equal_to(100000), f("o_totalprice").less_than(150000), f("o_orderstatus").neq("F"))


@query("select p_partkey, p_type from part where p_type like '%BRASS%' or p_name like '_a%'")
def filter_like(e):
    return select(f("p_partkey"), f("p_type")).from_("part").where(or_(f("p_type").like("%BRASS%"), f("p_name").like("_a%")))


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)")
def filter_in_list(e):
    return select(f("c_custkey")).from_("customer").where(and_(f("c_mktsegment").in_("BUILDING", "MACHINERY"), not_(f("c_nationkey").in_([1, 2, 3]))))


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def filter_in_subquery(e):
    return select(f("c_custkey")).from_("customer").where(f("c_nationkey").in_(select(f("n_nationkey")).from_("nation").where(f("n_regionkey").eq(2))))


@query("select c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
def filter_not_in(e):
    return select(f("c_custkey")).from_("customer").where(not_(f("c_nationkey").in_(select(f("n_nationkey")).from_("nation").where(f("n_regionkey").eq(2)))))


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)")
def filter_exists(e):
    inner = select(literal(1)).from_(table_ref("orders").as_("o")).where(f("o_custkey", "o").eq(f("c_custkey", "c")), f("o_totalprice", "o").greater_than(300000))
    return select(f("c_custkey", "c")).from_(table_ref("customer").as_("c")).where(exists(inner))


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')")
def filter_not_exists(e):
    inner = select(literal(1)).from_(table_ref("orders").as_("o")).where(and_(f("o_custkey", "o").eq(f("c_custkey", "c")), f("o_orderstatus", "o").eq("F")))
    return select(f("c_custkey", "c")).from_(table_ref("customer").as_("c")).where(not_(exists(inner)))


@query("select n_nationkey, coalesce(length(trim(nullif(n_name, 'FRANCE'))), 0) = 0 as e, n_name is not null as v from nation")
def filter_is_empty(e):
    name = case(when(f("n_name").eq("FRANCE")).then(None)).otherwise(f("n_name"))
    return select(f("n_nationkey"), is_empty(name).as_("e"), is_not_empty(f("n_name")).as_("v")).from_("nation")


@query("select o_orderkey from orders where not (o_orderstatus = 'O' and o_totalprice > 1000) or o_custkey is null")
def filter_and_or_not(e):
    return select(f("o_orderkey")).from_("orders").where(or_(not_(and_(f("o_orderstatus").eq("O"), f("o_totalprice").greater_than(1000))), f("o_custkey").is_null()))


@query("select n_nationkey, n_regionkey = 1 as is_one, (n_regionkey = 1) = (n_nationkey > 5) as same from nation")
def criterion_as_value(e):
    return select(f("n_nationkey"), f("n_regionkey").eq(1).as_("is_one"), f("n_regionkey").eq(1).eq(f("n_nationkey").greater_than(5)).as_("same")).from_("nation")


# -- joins --------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(e):
    return select(f("o_orderkey"), f("c_name")).from_("orders").inner_join("customer", f("o_custkey").eq(f("c_custkey")))


@query("select r_name, n_name from region cross join nation")
def join_cross(e):
    return select(f("r_name"), f("n_name")).from_("region").cross_join("nation")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000")
def join_left(e):
    return select(f("c_custkey"), f("o_orderkey")).from_("customer").left_outer_join("orders", and_(f("c_custkey").eq(f("o_custkey")), f("o_totalprice").greater_than(200000)))


@query("select c.k as c_nation, s.k as s_nation, c.n as customers, s.n as suppliers from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 5000 group by 1) c full join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 5000 group by 1) s on c.k = s.k")
def join_full(e):
    c = select(f("c_nationkey").as_("k"), fn.count().as_("n")).from_("customer").where(f("c_acctbal").greater_than(5000)).group_by(f("c_nationkey")).as_("c")
    s = select(f("s_nationkey").as_("k"), fn.count().as_("n")).from_("supplier").where(f("s_acctbal").greater_than(5000)).group_by(f("s_nationkey")).as_("s")
    return select(f("k", "c").as_("c_nation"), f("k", "s").as_("s_nation"), f("n", "c").as_("customers"), f("n", "s").as_("suppliers")).from_(c).full_outer_join(s, f("k", "c").eq(f("k", "s")))


@query("select s_suppkey, n_nationkey from supplier join nation on s_nationkey >= n_nationkey and s_nationkey < n_nationkey + 3")
def join_theta_range(e):
    return select(f("s_suppkey"), f("n_nationkey")).from_("supplier").inner_join("nation", and_(f("s_nationkey").greater_than_or_equal_to(f("n_nationkey")), f("s_nationkey").less_than(f("n_nationkey").plus(3))))


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(e):
    a, b = table_ref("nation").as_("a"), table_ref("nation").as_("b")
    return select(a.field("n_name").as_("a"), b.field("n_name").as_("b")).from_(a).inner_join(b, and_(a.field("n_regionkey").eq(b.field("n_regionkey")), a.field("n_nationkey").less_than(b.field("n_nationkey"))))


@query("select c_custkey, t.n from customer join (select o_custkey as k, count(*) as n from orders group by 1) t on c_custkey = t.k")
def join_subselect(e):
    t = select(f("o_custkey").as_("k"), fn.count().as_("n")).from_("orders").group_by(f("o_custkey")).as_("t")
    return select(f("c_custkey"), f("n", "t")).from_("customer").inner_join(t, f("c_custkey").eq(f("k", "t")))


@query("select r_name, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def join_three_way(e):
    return (
        select(f("r_name"), fn.count().as_("n"), fn.sum_(dec(f("o_totalprice"))).as_("total"))
        .from_("orders")
        .inner_join("customer", f("o_custkey").eq(f("c_custkey")))
        .inner_join("nation", f("c_nationkey").eq(f("n_nationkey")))
        .inner_join("region", f("n_regionkey").eq(f("r_regionkey")))
        .group_by(f("r_name"))
        .use_implicit_join_order()
    )


@query("select a.n_name, b.r_name from (select n_name, n_regionkey from nation) a, (select r_name, r_regionkey from region) b where a.n_regionkey = b.r_regionkey")
def derived_tables(e):
    a, b = select(f("n_name"), f("n_regionkey")).from_("nation").as_("a"), select(f("r_name"), f("r_regionkey")).from_("region").as_("b")
    return select(f("n_name", "a"), f("r_name", "b")).from_(a, b).where(f("n_regionkey", "a").eq(f("r_regionkey", "b")))


# -- aggregates ---------------------------------------------------------------------------------------


@query("select o_orderstatus, count(*) as n, count(o_custkey) as c, count(distinct o_custkey) as d from orders group by 1")
def agg_count_distinct(e):
    return select(f("o_orderstatus"), fn.count().as_("n"), fn.count(f("o_custkey")).as_("c"), fn.count_distinct(f("o_custkey")).as_("d")).from_("orders").group_by(f("o_orderstatus"))


@query("select l_returnflag, sum(distinct cast(l_quantity as decimal(18,2))) as s, sum(cast(l_quantity as decimal(18,2))) as t from lineitem group by 1")
def agg_sum_distinct(e):
    return select(f("l_returnflag"), fn.sum_distinct(dec(f("l_quantity"))).as_("s"), fn.sum_(dec(f("l_quantity"))).as_("t")).from_("lineitem").group_by(f("l_returnflag"))


@query("select l_returnflag, cast(round(avg(distinct l_linenumber), 6) as double) as d, cast(round(avg(l_linenumber), 6) as double) as a from lineitem group by 1")
def agg_avg_distinct(e):
    return select(f("l_returnflag"), fn.round_(fn.average_distinct(f("l_linenumber")), 6).as_("d"), fn.round_(fn.average(f("l_linenumber")), 6).as_("a")).from_("lineitem").group_by(f("l_returnflag"))


@query("select p_brand, min(p_retailprice) as lo, max(p_retailprice) as hi, min(p_name) as first_name from part group by 1")
def agg_min_max(e):
    return select(f("p_brand"), fn.min_(f("p_retailprice")).as_("lo"), fn.max_(f("p_retailprice")).as_("hi"), fn.min_(f("p_name")).as_("first_name")).from_("part").group_by(f("p_brand"))


@query("select n_regionkey, bool_or(n_nationkey > 20) as some_big, bool_and(n_nationkey > 2) as all_big from nation group by 1")
def agg_some_every(e):
    return select(f("n_regionkey"), fn.some(f("n_nationkey").greater_than(20)).as_("some_big"), fn.every(f("n_nationkey").greater_than(2)).as_("all_big")).from_("nation").group_by(f("n_regionkey"))


@query("select count(*) as n, count(o_custkey) as c, sum(o_custkey) as s, min(o_custkey) as m from orders where o_orderkey < 0")
def agg_global_empty(e):
    return select(fn.count().as_("n"), fn.count(f("o_custkey")).as_("c"), fn.sum_(f("o_custkey")).as_("s"), fn.min_(f("o_custkey")).as_("m")).from_("orders").where(f("o_orderkey").less_than(0))


@query("select o_custkey, count(*) as n from orders group by 1 having sum(cast(o_totalprice as decimal(18,2))) > 1000000")
def agg_group_having(e):
    return select(f("o_custkey"), fn.count().as_("n")).from_("orders").group_by(f("o_custkey")).having(fn.sum_(dec(f("o_totalprice"))).greater_than(1000000))


@query("select count(*) as n from nation having max(n_nationkey) > 3")
def having_without_group(e):
    return select(fn.count().as_("n")).from_("nation").having(fn.max_(f("n_nationkey")).greater_than(3))


@query("select substr(o_orderpriority, 1, 1) as p, count(*) as n from orders group by 1")
def agg_group_expr(e):
    first = fn.substring(f("o_orderpriority"), 1, 1)
    return select(first.as_("p"), fn.count().as_("n")).from_("orders").group_by(first)


# -- windows ------------------------------------------------------------------------------------------


@query("select o_orderkey, sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderkey) as running from orders")
def win_running_sum(e):
    return select(f("o_orderkey"), window(fn.sum_(dec(f("o_totalprice")))).partition_by(f("o_custkey")).order_by(f("o_orderkey")).as_("running")).from_("orders")


@query("select n_nationkey, cast(round(avg(n_nationkey) over (partition by n_regionkey), 6) as double) as a from nation")
def win_avg_partition(e):
    return select(f("n_nationkey"), fn.round_(window(fn.average(f("n_nationkey"))).partition_by(f("n_regionkey")), 6).as_("a")).from_("nation")


@query("select n_nationkey, count(*) over (order by n_regionkey) as peers from nation")
def win_count_peers(e):
    return select(f("n_nationkey"), window(fn.count()).order_by(f("n_regionkey")).as_("peers")).from_("nation")


@query("select p_partkey, min(p_retailprice) over (partition by p_brand) as lo, max(p_retailprice) over (partition by p_brand order by p_partkey) as hi from part")
def win_min_max(e):
    return select(f("p_partkey"), window(fn.min_(f("p_retailprice"))).partition_by(f("p_brand")).as_("lo"), window(fn.max_(f("p_retailprice"))).partition_by(f("p_brand")).order_by(f("p_partkey")).as_("hi")).from_("part")


@query("select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey asc nulls first) as integer) as rn from orders")
def win_row_number(e):
    return select(f("o_orderkey"), window(fn.row_number()).partition_by(f("o_custkey")).order_by(f("o_totalprice").desc(), f("o_orderkey")).as_("rn")).from_("orders")


@query("select n_nationkey, count(*) over () as n from nation")
def win_total(e):
    return select(f("n_nationkey"), window(fn.count()).as_("n")).from_("nation")


# -- order and limit ----------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25")
def topk_nulls(e):
    return select(f("o_orderkey"), f("o_totalprice")).from_("orders").order_by(f("o_totalprice").desc().nulls_last(), f("o_orderkey")).limit(25)


@query("select o_custkey, count(*) as n from orders group by 1 order by count(*) desc, o_custkey limit 10")
def limit_group(e):
    return select(f("o_custkey"), fn.count().as_("n")).from_("orders").group_by(f("o_custkey")).order_by(fn.count().desc(), f("o_custkey")).limit(10)


@query("select count(*) as n, sum(k) as s from (select o_orderkey as k from orders order by o_orderkey limit 100) t")
def limit_subquery(e):
    t = select(f("o_orderkey").as_("k")).from_("orders").order_by(f("o_orderkey")).limit(100).as_("t")
    return select(fn.count().as_("n"), fn.sum_(f("k")).as_("s")).from_(t)


@query("select o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey limit 1")
def first_row(e):
    return select_first(f("o_orderkey")).from_("orders").order_by(f("o_totalprice").desc(), f("o_orderkey"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(e):
    return select_distinct(f("o_orderstatus"), f("o_orderpriority")).from_("orders").order_by(f("o_orderstatus"))


# -- set operations -----------------------------------------------------------------------------------


@query("select c_nationkey as k from customer union select s_nationkey as k from supplier")
def union_distinct(e):
    return select(f("c_nationkey").as_("k")).from_("customer").union(select(f("s_nationkey").as_("k")).from_("supplier"))


@query("select c_nationkey as k from customer union all select s_nationkey as k from supplier")
def union_all_rows(e):
    return select(f("c_nationkey").as_("k")).from_("customer").union_all(select(f("s_nationkey").as_("k")).from_("supplier"))


@query("select o_custkey as k from orders except select c_custkey as k from customer where c_nationkey < 10")
def except_distinct(e):
    return select(f("o_custkey").as_("k")).from_("orders").except_(select(f("c_custkey").as_("k")).from_("customer").where(f("c_nationkey").less_than(10)))


@query("(select n_nationkey as k from nation union select r_regionkey as k from region) except select n_regionkey as k from nation where n_nationkey < 10")
def union_then_except(e):
    x = select(f("n_regionkey").as_("k")).from_("nation").where(f("n_nationkey").less_than(10))
    return select(f("n_nationkey").as_("k")).from_("nation").except_(x).union(select(f("r_regionkey").as_("k")).from_("region")).order_by(f("k"))


# -- functions ----------------------------------------------------------------------------------------


@query("select p_partkey, substr(p_name, 2, 4) as s, lower(p_name) as l, upper(p_name) as u, cast(length(p_name) as integer) as n from part")
def fn_string(e):
    return select(f("p_partkey"), fn.substring(f("p_name"), 2, 4).as_("s"), fn.lower_case(f("p_name")).as_("l"), fn.upper_case(f("p_name")).as_("u"), fn.length(f("p_name")).as_("n")).from_("part")


@query("select n_nationkey, lpad(n_name, 5, '*') as lp, rpad(n_name, 12, '.') as rp, trim('  ' || n_name || '  ') as t, ltrim('  ' || n_name) as lt, rtrim(n_name || '  ') as rt from nation")
def fn_pad_trim(e):
    return select(f("n_nationkey"), fn.left_pad(f("n_name"), 5, "*").as_("lp"), fn.right_pad(f("n_name"), 12, ".").as_("rp"), fn.trim(concat("  ", f("n_name"), "  ")).as_("t"), fn.left_trim(concat("  ", f("n_name"))).as_("lt"), fn.right_trim(concat(f("n_name"), "  ")).as_("rt")).from_("nation")


@query("select n_nationkey, cast(n_nationkey as bigint) % 7 as m, round(cast(n_nationkey as decimal(18,2)) / 2, 0)::double as r, cast(floor(n_nationkey / 4.0) as bigint) as fl, power(n_nationkey::double, 2) as p from nation")
def fn_numeric(e):
    return select(f("n_nationkey"), fn.mod(f("n_nationkey"), 7).as_("m"), fn.round_(dec(f("n_nationkey")).divide_by(2), 0).cast(DataType.DECIMAL, 18, 2).as_("r0"), fn.floor(f("n_nationkey").divide_by(4)).as_("fl"), fn.power(f("n_nationkey"), 2).as_("p")).from_("nation")


_REGISTRY["fn_numeric"] = (_REGISTRY["fn_numeric"][0], "select n_nationkey, cast(n_nationkey as bigint) % 7 as m, cast(round(cast(n_nationkey as decimal(18,2)) / 2, 0) as decimal(18,2)) as r0, cast(floor(n_nationkey / 4.0) as bigint) as fl, power(n_nationkey::double, 2) as p from nation")


@query("select o_orderkey, cast(o_orderdate as date) + 30 as d30, cast(cast(o_orderdate as date) + interval 1 month as date) as m1, cast(cast(o_orderdate as date) - interval 2 month as date) as m2 from orders")
def fn_date_add(e):
    return select(f("o_orderkey"), fn.add_days(f("o_orderdate"), 30).as_("d30"), fn.add_months(f("o_orderdate"), 1).as_("m1"), fn.add_months(f("o_orderdate"), -2).as_("m2")).from_("orders")


_MONTHS = """case when f = t then 0 when t > f then (year(t) - year(f)) * 12 + month(t) - month(f) + case when day(f) <= day(t) or t = last_day(t) then 0 else -1 end
 else (year(t) - year(f)) * 12 + month(t) - month(f) + case when day(t) <= day(f) or f = last_day(f) then 0 else 1 end end"""


@query(f"select k, cast(t - f as integer) as days, cast({_MONTHS} as integer) as months, cast(-1 * (t - f) as integer) as back from (select l_orderkey * 10 + l_linenumber as k, cast(o_orderdate as date) as f, cast(l_shipdate as date) as t from lineitem join orders on l_orderkey = o_orderkey) x")
def fn_days_months_between(e):
    return select(f("l_orderkey").multiply_by(10).plus(f("l_linenumber")).as_("k"), fn.days_between(f("o_orderdate"), f("l_shipdate")).as_("days"), fn.months_between(f("o_orderdate"), f("l_shipdate")).as_("months"), fn.days_between(f("l_shipdate"), f("o_orderdate")).as_("back")).from_("lineitem").inner_join("orders", f("l_orderkey").eq(f("o_orderkey")))


@query("select o_orderkey, last_day(cast(o_orderdate as date)) as d from orders")
def fn_last_day(e):
    return select(f("o_orderkey"), fn.last_day_of_month(f("o_orderdate")).as_("d")).from_("orders")


@query("select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as decimal(8,0)) as n, cast(o_orderdate as date) as d, cast(strftime(o_orderdate, '%Y%m%d%H%M%S') as decimal(14,0)) as s from orders")
def fn_yyyymmdd(e):
    return select(f("o_orderkey"), fn.date_to_yyyymmdd(f("o_orderdate")).as_("n"), fn.yyyymmdd_to_date(fn.date_to_yyyymmdd(f("o_orderdate"))).as_("d"), fn.date_to_yyyymmddhhmmss(f("o_orderdate")).as_("s")).from_("orders")


@query("select n_nationkey, coalesce(nullif(n_regionkey, 1), 99) as c, case when n_regionkey = 0 then date '1970-01-01' else date '2020-01-31' end as d from nation")
def fn_coalesce(e):
    zero = case(when(f("n_regionkey").eq(0)).then(0)).otherwise(20200131)
    return select(f("n_nationkey"), fn.coalesce(case(when(f("n_regionkey").eq(1)).then(None)).otherwise(f("n_regionkey")), 99).cast(DataType.INTEGER).as_("c"), fn.cast_as_date_replace_if_null_or_zero(zero, fn.yyyymmdd_to_date("19700101")).as_("d")).from_("nation")


@query("select l_orderkey, l_linenumber, greatest(l_tax, l_discount, nullif(l_quantity, 1)) as g, least(l_tax, l_discount) as l from lineitem")
def fn_greatest_least(e):
    return select(f("l_orderkey"), f("l_linenumber"), fn.greatest(f("l_tax"), f("l_discount"), case(when(f("l_quantity").eq(1)).then(None)).otherwise(f("l_quantity"))).as_("g"), fn.least(f("l_tax"), f("l_discount")).as_("l")).from_("lineitem")


@query("select n_nationkey, cast(octet_length(encode(n_name)) as integer) as b from nation")
def fn_blob_length(e):
    return select(f("n_nationkey"), fn.blob_length(f("n_name").cast(DataType.BLOB)).as_("b")).from_("nation")


@query(None)
def fn_random(e):
    return select(f("n_nationkey"), fn.random().as_("r")).from_("nation")


@query(None)
def fn_random_string(e):
    return select(f("n_nationkey"), fn.random_string(40).as_("r")).from_("nation")


@query(None)
def fn_now(e):
    return select(fn.now().as_("n"))


# -- subqueries ---------------------------------------------------------------------------------------


@query("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
def scalar_subquery(e):
    mean = select(fn.average(f("o_totalprice")).multiply_by(1.5)).from_("orders")
    return select(f("o_orderkey")).from_("orders").where(f("o_totalprice").greater_than(mean.as_field()))


@query("select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as n from nation")
def correlated_subquery(e):
    inner = select(fn.count()).from_("customer").where(f("c_nationkey", "customer").eq(f("n_nationkey", "nation")))
    return select(f("n_nationkey"), inner.as_field().as_("n")).from_("nation")


@query("select n_nationkey, (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 1) as best from nation")
def correlated_first(e):
    inner = select_first(f("s_suppkey")).from_("supplier").where(f("s_nationkey", "supplier").eq(f("n_nationkey", "nation"))).order_by(f("s_acctbal").desc(), f("s_suppkey"))
    return select(f("n_nationkey"), inner.as_field().as_("best")).from_("nation")


# -- data changes: the snapshot that results ----------------------------------------------------------


@query("select * from region union all select cast(n_nationkey + 100 as integer), n_name from nation where n_regionkey = 1")
def dml_insert_select(e):
    return e.changed(insert().into("region").fields("r_regionkey", "r_name").from_(select(f("n_nationkey").plus(100), f("n_name")).from_("nation").where(f("n_regionkey").eq(1))))


@query("select r_regionkey, r_name from region union all select 77, 'dflt'")
def dml_insert_defaults(e):
    return e.changed(insert().into("region").values(literal(77).as_("r_regionkey")).with_defaults(literal("dflt").as_("r_name")))


@query("select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as p, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as s from orders")
def dml_update(e):
    e.put("orders", e.changed(update("orders").set(f("o_totalprice").multiply_by(2).as_("o_totalprice"), literal("X").as_("o_orderstatus")).where(f("o_orderstatus").eq("F"))))
    return select(f("o_orderkey"), f("o_totalprice").as_("p"), f("o_orderstatus").as_("s")).from_("orders")


@query("select n_nationkey, cast((select count(*) from supplier where s_nationkey = n_nationkey) as integer) as n_regionkey from nation")
def dml_update_correlated(e):
    inner = select(fn.count()).from_("supplier").where(f("s_nationkey", "supplier").eq(f("n_nationkey", "nation")))
    return e.changed(update("nation").set(inner.as_field().as_("n_regionkey"))).select("n_nationkey", "n_regionkey")


@query("select * from customer where not (c_acctbal < 0)")
def dml_delete(e):
    return e.changed(delete("customer").where(f("c_acctbal").less_than(0)))


@query("select count(*) - 7 as n from nation")
def delete_limit(e):
    e.put("nation", e.changed(delete("nation").limit(7)))
    return select(fn.count().as_("n")).from_("nation")


@query("select * from nation where false")
def dml_truncate(e):
    return e.changed(truncate("nation"))


_SOURCE = "(select n_nationkey * 2 as r_regionkey, upper(n_name) as r_name from nation where n_regionkey = 0)"


def _source():
    return select(f("n_nationkey").multiply_by(2).cast(DataType.INTEGER).as_("r_regionkey"), fn.upper_case(f("n_name")).as_("r_name")).from_("nation").where(f("n_regionkey").eq(0))


@query(f"select coalesce(t.r_regionkey, s.r_regionkey) as r_regionkey, coalesce(s.r_name, t.r_name) as r_name from region t full join {_SOURCE} s on t.r_regionkey = s.r_regionkey")
def dml_merge(e):
    return e.changed(merge().into("region").table_unique_key("r_regionkey").from_(_source()))


@query(f"select coalesce(t.r_regionkey, s.r_regionkey) as r_regionkey, case when t.r_regionkey is null then s.r_name when s.r_regionkey is null then t.r_name else s.r_name || '+' || t.r_name end as r_name from region t full join {_SOURCE} s on t.r_regionkey = s.r_regionkey")
def dml_merge_if_updating(e):
    return e.changed(merge().into("region").table_unique_key("r_regionkey").from_(_source()).if_updating(concat(incoming("r_name"), "+", existing("r_name")).as_("r_name")))


@query(f"select coalesce(t.r_regionkey, s.r_regionkey) as r_regionkey, case when t.r_regionkey is null or (s.r_regionkey is not null and t.r_regionkey > 0) then s.r_name else t.r_name end as r_name from region t full join {_SOURCE} s on t.r_regionkey = s.r_regionkey")
def dml_merge_only_where(e):
    return e.changed(merge().into("region").table_unique_key("r_regionkey").from_(_source()).only_where(existing("r_regionkey").greater_than(0)))


@query(f"select r_regionkey, r_name from region union select * from {_SOURCE}")
def dml_merge_all_keys(e):
    return e.changed(merge().into("region").table_unique_key("r_regionkey", "r_name").from_(_source()))


@query("select c_custkey as id, c_name as name from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_suppkey) as id, 'new' as name from supplier")
def dml_autonumber(e):
    e.put("people", e.query(select(f("c_custkey").as_("id"), f("c_name").as_("name")).from_("customer")))
    return e.changed(insert().into("people").fields("name").from_(select(literal("new").as_("name")).from_("supplier")))


# -- data sets, comparison, evolution -----------------------------------------------------------------


@query("select c_custkey, cast(null as varchar) as c_name, c_nationkey, cast(null as double) as c_acctbal, c_mktsegment from customer")
def mask_columns(e):
    return masked(e.table("customer"), ["C_NAME", "c_acctbal"])


@query("select cast(n_nationkey as bigint) as N_NATIONKEY, n_name as N_NAME from nation")
def metadata_overlay(e):
    t = table("nation").columns(column("N_NATIONKEY", DataType.BIG_INTEGER).primary_key(), column("N_NAME", DataType.STRING, 25))
    return WithMetadata(Frames({"nation": e.table("nation")}), schema(t)).records("nation")


@query("select cast(n_nationkey as varchar) as key, 'n_name' as column_name, n_name as left_value, upper(n_name) || '!' as right_value, 'MISMATCH' as kind from nation where n_regionkey = 3")
def diff_keyed(e):
    t = table("nation").columns(column("n_nationkey", DataType.INTEGER).primary_key(), column("n_name", DataType.STRING, 25), column("n_regionkey", DataType.INTEGER))
    other = e.changed(update("nation").set(concat(fn.upper_case(f("n_name")), "!").as_("n_name")).where(f("n_regionkey").eq(3)))
    return table_diff(e.table("nation"), other, t)


@query("select cast(n_nationkey as varchar) as key, c as column_name, case when c = 'n_name' then n_name else cast(n_regionkey as varchar) end as left_value, cast(null as varchar) as right_value, 'MISSING_RIGHT' as kind from nation, (values ('n_name'), ('n_regionkey')) v(c) where n_nationkey >= 20")
def diff_resultset(e):
    return result_diff(e.table("nation"), e.table("nation").where("n_nationkey < 20"), keys=(1,))


@query("select n_nationkey, n_name, n_regionkey, 'none' as note from nation")
def evolve_add_column(e):
    from quernel.operators.evolve import AddColumn

    return AddColumn("nation", column("note", DataType.STRING, 10).nullable(), "none").rewrite(e.table("nation"))


@query("select n_nationkey, n_name as title, cast(n_regionkey as bigint) as n_regionkey from nation")
def evolve_change_column(e):
    from quernel.operators.evolve import ChangeColumn

    df = ChangeColumn("nation", column("n_name", DataType.STRING, 25), column("title", DataType.STRING, 30)).rewrite(e.table("nation"))
    return ChangeColumn("nation", column("n_regionkey", DataType.DECIMAL, 10, 0), column("n_regionkey", DataType.BIG_INTEGER)).rewrite(df)


@query("select cast(n_nationkey as bigint) as id, substr(n_name, 1, 5) as name from nation")
def ctas_cast(e):
    return select(f("n_nationkey").cast(DataType.BIG_INTEGER).as_("id"), f("n_name").as_string(5).as_("name")).from_("nation")


@query("select r_name, n from (select n_regionkey as k, count(*) as n from nation group by 1) a join region on a.k = r_regionkey where n >= 5")
def view_chain(e):
    counts = view("v_counts", select(f("n_regionkey").as_("k"), fn.count().as_("n")).from_("nation").group_by(f("n_regionkey")))
    named = view("v_named", select(f("r_name"), f("n", "v_counts")).from_("v_counts").inner_join("region", f("k", "v_counts").eq(f("r_regionkey"))), "v_counts")
    e.deploy_views([named, counts])
    return select(f("r_name"), f("n")).from_("v_named").where(f("n").greater_than_or_equal_to(5))


@query("select n_nationkey || ',' || n_name || ',' || n_regionkey as record from nation")
def record_join(e):
    from quernel.operators.compare import joined

    return joined(e.table("nation"))


@query("select row_number() over () + 4 as v from customer")
def sequence_values(e):
    from quernel.plans.expr import next_value
    from quernel.sources.schema import sequence

    e.sequences.create(sequence("seq", 5))
    return select(next_value("seq").as_("v")).from_("customer")


@query("select event_type, count(*) as n, sum(cast(value as decimal(18,2))) as total, min(ts) as first_ts from events group by 1")
def events_by_type(e):
    return select(f("event_type"), fn.count().as_("n"), fn.sum_(dec(f("value"))).as_("total"), fn.min_(f("ts")).as_("first_ts")).from_("events").group_by(f("event_type"))


# -- orders of nulls, hints, batches, data sets and upgrades over tables that nothing has opened yet -----


def _tenths():
    """A key of customers that is null for every tenth."""
    return null_if_zero(fn.mod(f("c_custkey"), 10))


_TENTHS = "nullif(c_custkey % 10, 0)"


@query(f"select c_custkey, {_TENTHS} as k from customer order by {_TENTHS} asc nulls first, c_custkey limit 200")
def order_nulls_default_ascending(e):
    return select(f("c_custkey"), _tenths().as_("k")).from_("customer").order_by(_tenths(), f("c_custkey")).limit(200)


@query(f"select c_custkey, {_TENTHS} as k from customer order by {_TENTHS} desc nulls last, c_custkey limit 200")
def order_nulls_default_descending(e):
    return select(f("c_custkey"), _tenths().as_("k")).from_("customer").order_by(_tenths().desc(), f("c_custkey")).limit(200)


@query(f"select c_custkey, {_TENTHS} as k from customer order by {_TENTHS} desc nulls first, c_custkey limit 200")
def order_nulls_first(e):
    return select(f("c_custkey"), _tenths().as_("k")).from_("customer").order_by(_tenths().desc().nulls_first(), f("c_custkey")).limit(200)


@query(f"select c_custkey, {_TENTHS} as k from customer order by {_TENTHS} asc nulls last, c_custkey limit 200")
def order_nulls_last(e):
    return select(f("c_custkey"), _tenths().as_("k")).from_("customer").order_by(_tenths().asc().nulls_last(), f("c_custkey")).limit(200)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25")
def order_with_parallel_hint(e):
    return select(f("o_orderkey"), f("o_totalprice")).from_("orders").order_by(f("o_totalprice").desc(), f("o_orderkey")).limit(25).parallel(3)


@query("select row_number() over () as v from orders")
def row_number_bare(e):
    return select(fn.any_row_number().as_("v")).from_("orders")


@query(f"select c_custkey, coalesce({_TENTHS}, -1) as k from customer")
def fn_isnull(e):
    return select(f("c_custkey"), fn.isnull(_tenths(), literal(-1)).as_("k")).from_("customer")


@query("select r_regionkey, r_name from region union all select 50, 'fifty' union all select 51, 'fifty-one'")
def insert_batch(e):
    e.execute_batch(insert().into("region"), [{"r_regionkey": 50, "r_name": "fifty"}, {"r_regionkey": 51, "r_name": "fifty-one"}])
    return select(f("r_regionkey"), f("r_name")).from_("region")


def _region():
    return table("region").columns(column("r_regionkey", DataType.INTEGER).primary_key(), column("r_name", DataType.STRING, 25))


@query(f"select coalesce(t.r_regionkey, s.r_regionkey) as r_regionkey, coalesce(s.r_name, t.r_name) as r_name from region t full join {_SOURCE} s on t.r_regionkey = s.r_regionkey")
def dataset_merge(e):
    from quernel.sources.datasets import Merging, connect

    connect(Frames({"region": e.query(_source())}, schema(_region())), Merging(e))
    return e.table("region")


@query("select o_custkey, count(*) as n from orders group by 1")
def sql_query_dataset(e):
    from quernel.sources.datasets import SqlQuery

    e.table("orders").createOrReplaceTempView("quernel_orders")
    return SqlQuery(e.spark, "counts", "select o_custkey, count(*) as n from quernel_orders group by o_custkey").records("counts")


@query("select n_nationkey, n_regionkey from nation")
def evolve_remove_column(e):
    from quernel.operators.evolve import RemoveColumn

    return RemoveColumn("nation", column("n_name", DataType.STRING, 25)).rewrite(e.table("nation"))


def _upgrade(e, graph: bool):
    """Adds a column to region, makes a table of its rows and removes the column's old neighbour there."""
    from quernel.operators.evolve import Step, Upgrade

    e.schema = schema(_region())
    wide = table("wide").columns(column("id", DataType.BIG_INTEGER).primary_key(), column("name", DataType.STRING, 25), column("note", DataType.STRING, 10).nullable())
    short = table("wide").columns(column("id", DataType.BIG_INTEGER).primary_key(), column("note", DataType.STRING, 10).nullable())
    note = column("note", DataType.STRING, 10).nullable()

    def first(r):
        r.add_column("region", note, "none")

    def second(r):
        r.add_table_from(wide, select(f("r_regionkey"), f("r_name"), f("note")).from_("region"))

    def third(r):
        r.execute(update("wide").set(literal("high").as_("note")).where(f("id").greater_than(1)))
        r.remove_column("wide", "name")

    region = table("region").columns(*_region().column_list, note)
    steps = [Step("s1", 1, "note", first), Step("s2", 2, "copy", second, reads=("region",)), Step("s3", 3, "short", third)]
    Upgrade(e, schema(region, short), steps).perform(graph=graph)
    return select(f("id"), f("note")).from_("wide")


@query("select cast(r_regionkey as bigint) as id, case when r_regionkey > 1 then 'high' else 'none' end as note from region")
def upgrade_path(e):
    return _upgrade(e, False)


@query("select cast(r_regionkey as bigint) as id, case when r_regionkey > 1 then 'high' else 'none' end as note from region")
def upgrade_graph(e):
    return _upgrade(e, True)


@query("select n_regionkey as r_regionkey, max(n_name) as r_name from nation group by 1")
def replace_table_from(e):
    from quernel.operators.evolve import ReplaceTable

    e.schema = schema(_region())
    ReplaceTable(_region(), select(f("n_regionkey"), fn.max_(f("n_name"))).from_("nation").group_by(f("n_regionkey"))).run(e)
    return e.table("region")
