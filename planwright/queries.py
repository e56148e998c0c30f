"""Queries over the sample star schema, each by the engine, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORD
from .engine import Engine
from .operators import calendar, grid, merge, rows
from .sources import delimited, records
from .streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MONTHS = 84  # from January 1995


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return keep


def ordered(key: Column) -> Column:
    """A key as a row order that keeps runs of 16,384 rows together."""
    return F.shiftleft(F.floor(key / 16384).cast("long"), 33) + F.pmod(key, F.lit(16384))


def star(spark: SparkSession, d: str, *tables: str) -> Engine:
    """The sample tables as a model: references by id, months of orders' dates."""
    e = Engine(spark)
    e.create_model("m")
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    e.create_periods("m", "periods", "1995-01", MONTHS, "month", "1999-12-31")
    k = lambda c: F.col(c).cast("string")
    made = {
        "region": lambda: (read("region").select(k("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias(ORD)), {"name": "text"}),
        "nation": lambda: (read("nation").select(k("n_nationkey").alias("id"), F.col("n_name").alias("name"), k("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias(ORD)), {"name": "text", "region": "ref:region"}),
        "customer": lambda: (read("customer").select(k("c_custkey").alias("id"), F.col("c_name").alias("name"), k("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), ordered(F.col("c_custkey")).alias(ORD)), {"name": "text", "nation": "ref:nation", "segment": "text", "balance": "number"}),
        "supplier": lambda: (read("supplier").select(k("s_suppkey").alias("id"), F.col("s_name").alias("name"), k("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias(ORD)), {"name": "text", "nation": "ref:nation", "balance": "number"}),
        "part": lambda: (read("part").select(k("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), ordered(F.col("p_partkey")).alias(ORD)), {"brand": "text", "size": "number", "price": "number"}),
        "orders": lambda: (read("orders").select(k("o_orderkey").alias("id"), k("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), ordered(F.col("o_orderkey")).alias(ORD)), {"customer": "ref:customer", "date": "date", "status": "text", "priority": "text", "total": "number", "period": "ref:periods*"}),
        "lineitem": lambda: (read("lineitem").select(F.concat_ws("-", k("l_orderkey"), k("l_linenumber")).alias("id"), k("l_orderkey").alias("order"), k("l_partkey").alias("part"), k("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), ordered(F.col("l_orderkey")).alias(ORD)), {"order": "ref:orders", "part": "ref:part", "supplier": "ref:supplier", "quantity": "number", "price": "number", "discount": "number", "tax": "number", "flag": "text"}),
    }
    for t in tables:
        df, fields = made[t]()
        e.create_table("m", t, fields, df=df)
    if "orders" in tables:
        e.set_rules("m", "orders", "period = PERIOD(date, periods)")
    return e


def lines(e: Engine, id: str, *names: str, **attrs: list) -> None:
    e.create_table("m", id, {k: "text" for k in attrs}, [{"id": n, **{k: v[i] for k, v in attrs.items()}} for i, n in enumerate(names)])


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    return df.select(*((F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# SQL shared by several: months as members, each nation's orders by month

PERIODS = f"""per as (select i as idx, (date '1995-01-01' + to_months(i::int))::date as start,
  lower(strftime(date '1995-01-01' + to_months(i::int), '%b%y')) as period,
  case when date '1995-01-01' + to_months((i + 1)::int) <= date '2000-01-01' then 'hist' else 'fcst' end as frame from range({MONTHS}) t(i))"""
SALES = f"""with {PERIODS}, s as (
  select c_nationkey as n, date_trunc('month', o_orderdate)::date as start, sum(o_totalprice) as v, count(*) as k
  from orders join customer on o_custkey = c_custkey group by all
), x as (select n_nationkey::varchar as nation, n_nationkey as nk, n_regionkey as rk, period, idx, frame, coalesce(v, 0) as v, coalesce(k, 0) as k
  from nation cross join per left join s on s.n = n_nationkey and s.start = per.start)"""


def sales(spark: SparkSession, d: str, rules: str, *names: str, **attrs: list) -> Engine:
    """Nations by months by the named line items."""
    e = star(spark, d, "region", "nation", "customer", "orders")
    lines(e, "lines", *names, **attrs)
    e.create_pivot("m", "sales", [("nation", "nation"), ("line", "lines"), ("period", "periods")], "line", "period")
    e.set_rules("m", "sales", rules)
    return e


@query("q_fk_rollup", SALES + " select nation, period, round(v, 2) + 0.0 as amount from x")
def q_fk_rollup(spark, d):
    return rounded(sales(spark, d, "amount = SUM(orders.total)", "amount").wide("m", "sales"))


@query("q_explicit_key", "select lower(c_mktsegment) as segment, round(sum(o_totalprice), 2) + 0.0 as amount, count(*)::double as orders from orders join customer on o_custkey = c_custkey group by 1")
def q_explicit_key(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    e.create_distinct("m", "segments", "customer", "segment")
    lines(e, "lines", "amount", "orders")
    e.create_pivot("m", "p", [("segment", "segments"), ("line", "lines")], "line")
    e.set_rules("m", "p", "amount = SUM(orders.total[customer.segment=@segment])\norders = COUNTD(orders.id[customer.segment=@segment])")
    return rounded(e.wide("m", "p")).withColumn("segment", F.lower("segment"))


@query("q_attr_key", "select n_regionkey::varchar as region, round(sum(o_totalprice), 2) + 0.0 as amount from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def q_attr_key(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    lines(e, "lines", "amount")
    e.create_pivot("m", "p", [("region", "region"), ("line", "lines")], "line")
    e.set_rules("m", "p", "amount = SUM(orders.total[customer.nation.region=@region])")
    return rounded(e.wide("m", "p"))


@query("q_computed_field", "select l_orderkey::varchar || '-' || l_linenumber as id, round(l_extendedprice * (1 - l_discount), 4) + 0.0 as net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) + 0.0 as charge, case when l_quantity > 25 then 'big' else 'small' end as size from lineitem")
def q_computed_field(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders", "supplier", "part", "lineitem")
    for f in ({"id": "net", "type": "number", "computed": True}, {"id": "charge", "type": "number", "computed": True}, {"id": "size", "computed": True}):
        e.add_field("m", "lineitem", f)
    e.set_rules("m", "lineitem", 'net = price * (1 - discount)\ncharge = net * (1 + tax)\nsize = IF(quantity > 25, "big", "small")')
    return e.table("m", "lineitem").select("id", (F.round("net", 4) + 0.0).alias("net"), (F.round("charge", 6) + 0.0).alias("charge"), "size")


@query("q_ref_path", "select o_orderkey::varchar as id, n_name as nation, r_name as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_ref_path(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    for f in ("nation", "region"):
        e.add_field("m", "orders", {"id": f, "computed": True})
    e.set_rules("m", "orders", "nation = customer.nation.name\nregion = customer.nation.region.name")
    return e.table("m", "orders").select("id", "nation", "region")


@query("q_rule_dispatch", SALES + ", y as (select *, case when idx // 12 + 1995 >= 2001 then 3.0 when frame = 'fcst' then 2.0 when nk in (3, 5) then 1.0 else 0.0 end as plan from x) select nation, period, plan, plan * 10 as tenfold from y")
def q_rule_dispatch(spark, d):
    return sales(spark, d, 'plan = 0\nplan[nation in ("3", "5")] = 1\nplan[frame=fcst] = 2\nplan[period.year >= 2001] = 3\ntenfold = plan * 10', "plan", "tenfold").wide("m", "sales")


@query("q_input_override", SALES + " select nation, period, case when nk = 2 and period = 'mar95' then 42.0 when nk = 4 and period = 'jan96' then 0.0 else round(v, 2) + 0.0 end as amount, case when (nk = 2 and period = 'mar95') or (nk = 4 and period = 'jan96') then 2 else 1 end as state from x")
def q_input_override(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    e.set_value("m", "sales", {"nation": "2", "line": "amount", "period": "mar95"}, 42)
    e.set_value("m", "sales", {"nation": "4", "line": "amount", "period": "jan96"}, 0)
    return rounded(e.cells("m", "sales").select("nation", "period", F.col("value").alias("amount"), "state"))


AGGS = "sum avg count counta countblank min max median countd".split()


@query("q_agg_all", """
with x as (select c_nationkey::varchar as nation, case when o_orderkey % 7 = 0 then null else o_totalprice end as v, o_orderpriority as p from orders join customer on o_custkey = c_custkey)
select nation, round(coalesce(sum(v), 0), 2) + 0.0 as sum, round(avg(v), 4) + 0.0 as avg, count(v)::double as count, count(v)::double as counta, count(*) filter (where v is null)::double as countblank,
  round(min(v), 2) + 0.0 as min, round(max(v), 2) + 0.0 as max, round(median(v), 4) + 0.0 as median, count(distinct lower(p))::double as countd from x group by nation""")
def q_agg_all(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    e.add_field("m", "orders", {"id": "v", "type": "number", "computed": True})
    e.set_rules("m", "orders", "v = IF(MOD(VALUE(id), 7) = 0, BLANK, total)", replace=False)
    lines(e, "lines", *AGGS)
    e.create_pivot("m", "p", [("nation", "nation"), ("line", "lines")], "line")
    e.set_rules("m", "p", "\n".join(f"{a} = {a.upper()}(orders.{'priority' if a == 'countd' else 'v'})" for a in AGGS))
    out = e.wide("m", "p")
    return out.select("nation", *((F.round(a, 4 if a in ("avg", "median") else 2) + 0.0).alias(a) for a in AGGS)).join(e.planner.spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("nation")).distinct(), "nation", "left_semi")


@query("q_first_last_listagg", """
select n_regionkey::varchar as region, arg_min(n_name, n_nationkey) as first, arg_max(n_name, n_nationkey) as last, string_agg(n_name, '; ' order by n_nationkey) as names from nation group by 1""")
def q_first_last_listagg(spark, d):
    e = star(spark, d, "region", "nation")
    lines(e, "lines", "first", "last", "names")
    e.create_pivot("m", "p", [("region", "region"), ("line", "lines")], "line", measures=[{"id": "value", "type": "text"}])
    e.set_rules("m", "p", 'first = FIRST(nation.name)\nlast = LAST(nation.name)\nnames = LISTAGG(nation.name, "; ")')
    return e.wide("m", "p")


@query("q_filtered_aggs", """
select c_nationkey::varchar as nation, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0), 2) + 0.0 as open, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) + 0.0 as filled,
  count(*) filter (where o_totalprice >= 100000)::double as large, count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH'))::double as urgent
from orders join customer on o_custkey = c_custkey group by 1""")
def q_filtered_aggs(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    lines(e, "lines", "open", "filled", "large", "urgent")
    e.create_pivot("m", "p", [("nation", "nation"), ("line", "lines")], "line")
    e.set_rules("m", "p", 'open = SUM(orders.total[status=o])\nfilled = SUM(orders.total[status=F])\nlarge = COUNT(orders.total[total >= 100000])\nurgent = COUNTA(orders.id[priority in ("1-urgent", "2-HIGH")])')
    return rounded(e.wide("m", "p")).join(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("nation")).distinct(), "nation", "left_semi")


@query("q_marginal", SALES + " select rk::varchar as region, period, round(sum(v), 2) + 0.0 as amount, round(max(v), 2) + 0.0 as best from x group by all")
def q_marginal(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    lines(e, "region_lines", "amount", "best")
    e.create_pivot("m", "regional", [("region", "region"), ("line", "region_lines"), ("period", "periods")], "line", "period")
    e.set_rules("m", "regional", "amount = SUM(sales.amount[nation.region=@region])\nbest = MAX(sales.amount[nation.region=@region])")
    return rounded(e.wide("m", "regional"))


@query("q_share_of_total", SALES + " select nation, period, round(v, 2) + 0.0 as amount, case when sum(v) over (partition by period) = 0 then null else round(v / sum(v) over (partition by period), 9) + 0.0 end as share from x")
def q_share_of_total(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)\nshare = amount / SUM(amount[nation=all])", "amount", "share")
    return e.wide("m", "sales").select("nation", "period", (F.round("amount", 2) + 0.0).alias("amount"), (F.round("share", 9) + 0.0).alias("share"))


@query("q_mask_and_line_sets", SALES + """, y as (select *, k * 2.0 as b, k * 3.0 as c from x)
select nation, period, k::double as a, b, c, (sum(case when nk <> 0 then k end) over (partition by period))::double as others, (k + b + c)::double as all_three, (b + c)::double as flows, (k + b)::double as a_to_b from y""")
def q_mask_and_line_sets(spark, d):
    return sales(spark, d, 'a = COUNT(orders.total)\nb = a * 2\nc = a * 3\nothers = SUM(a[nation != "0"])\nall_three = SUM(value[line in (a, b, c)])\nflows = SUM(value[line.kind = flow])\na_to_b = SUM(value[line = a..b])', "a", "b", "c", "others", "all_three", "flows", "a_to_b", kind=["base", "flow", "flow", "set", "set", "set", "set"]).wide("m", "sales")


@query("q_time_windows", SALES + """ select nation, period, k::double as n, lag(k) over w::double as prev, lead(k, 2) over w::double as next2, (sum(k) over (w rows unbounded preceding))::double as cum,
  round(avg(k) over (w rows 2 preceding), 9) + 0.0 as trail, (max(k) over (w rows between 3 preceding and 1 preceding))::double as best3, (first_value(k) over (w rows between unbounded preceding and unbounded following))::double as first, (last_value(k) over (w rows between unbounded preceding and unbounded following))::double as last
from x window w as (partition by nation order by idx)""")
def q_time_windows(spark, d):
    e = sales(spark, d, "n = COUNT(orders.total)\nprev = PREV(n)\nnext2 = NEXT(n, 2)\ncum = CUMSUM(n)\ntrail = TRAILING(n, 3, AVG)\nbest3 = MAX(n[period = this-3..this-1])\nfirst = FIRST(n)\nlast = LAST(n)", "n", "prev", "next2", "cum", "trail", "best3", "first", "last")
    return rounded(e.wide("m", "sales"), 9)


@query("q_row_order", """
select o_orderkey::varchar as id, (row_number() over w - 1)::double as i, round(sum(o_totalprice) over (w rows unbounded preceding), 2) + 0.0 as running, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, first_value(o_totalprice) over w as first
from orders window w as (order by o_orderkey)""")
def q_row_order(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    for f in ("i", "running", "before", "after", "first"):
        e.add_field("m", "orders", {"id": f, "type": "number", "computed": True})
    e.set_rules("m", "orders", "i = row\nrunning = running[row-1] + total\nbefore = total[row-1]\nafter = total[row+1]\nfirst = total[row=first]")
    return e.table("m", "orders").select("id", "i", (F.round("running", 2) + 0.0).alias("running"), "before", "after", "first")


@query("q_forecast_fold", SALES + """, z as (select nation, max(case when idx = 59 then v end) as base from x group by nation)
select x.nation, period, round(case when frame = 'hist' then v else base * power(1.01, idx - 59) end, 2) + 0.0 as amount from x join z on x.nation = z.nation""")
def q_forecast_fold(spark, d):
    return rounded(sales(spark, d, "amount[frame=hist] = SUM(orders.total)\namount[frame=fcst] = PREV(amount) * 1.01", "amount").wide("m", "sales"))


@query("q_multi_pivot_fold", f"""
with recursive {PERIODS}, r as (
  select n_nationkey::varchar as nation, 0 as idx, (1000.0 + n_nationkey)::double as debt, 100.0::double as cash, 0.0::double as interest, 0.0::double as flow from nation
  union all select nation, r.idx + 1, debt + 0.5 * (debt * 0.08 - 20), cash - 0.25 * (debt * 0.08 - 20), debt * 0.08, debt * 0.08 - 20 from r where r.idx < {MONTHS - 1}
) select nation, period, round(debt, 4) + 0.0 as debt, round(cash, 4) + 0.0 as cash, round(interest, 4) + 0.0 as interest, round(flow, 4) + 0.0 as flow from r join per on r.idx = per.idx""")
def q_multi_pivot_fold(spark, d):
    e = star(spark, d, "region", "nation")
    lines(e, "income_lines", "interest", "flow")
    lines(e, "balance_lines", "debt", "cash")
    e.create_pivot("m", "income", [("nation", "nation"), ("line", "income_lines"), ("period", "periods")], "line", "period")
    e.create_pivot("m", "balance", [("nation", "nation"), ("line", "balance_lines"), ("period", "periods")], "line", "period")
    e.set_rules("m", "balance", "debt = PREV(debt) + 0.5 * income.flow\ndebt[period=jan95] = 1000 + VALUE(@nation)\ncash = PREV(cash) - 0.25 * income.flow\ncash[period=jan95] = 100")
    e.set_rules("m", "income", "interest = balance.debt[period-1] * 0.08\nflow = interest - 20\nflow[period=jan95] = 0")
    return rounded(e.wide("m", "balance").join(e.wide("m", "income"), ["nation", "period"]), 4)


UNITS = "with u as (select 'w' as id, null as parent, 1.0 as pct union all select 'r' || r_regionkey, 'w', 0.2 from region union all select 'n' || n_nationkey, 'r' || n_regionkey, 0.1 + n_nationkey / 100.0 from nation)"


def units(spark, d) -> Engine:
    e = Engine(spark)
    e.create_model("m")
    r, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    top = spark.range(1).select(F.lit("w").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1.0).alias("pct"), F.lit(0).cast("long").alias(ORD))
    mid = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("w").alias("parent"), F.lit(0.2).alias("pct"), (F.col("r_regionkey") + 1).cast("long").alias(ORD))
    low = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), (0.1 + F.col("n_nationkey") / 100).alias("pct"), (F.col("n_nationkey") + 100).cast("long").alias(ORD))
    e.create_table("m", "units", {"parent": "ref:units", "pct": "number"}, df=top.union(mid).union(low))
    return e


@query("q_hierarchy_topdown", UNITS + """ select u.id as unit, round(case when u.parent is null then 1000.0 when p.parent is null then 1000.0 * u.pct else 1000.0 * p.pct * u.pct end, 6) + 0.0 as goal from u left join u p on u.parent = p.id""")
def q_hierarchy_topdown(spark, d):
    e = units(spark, d)
    lines(e, "lines", "goal")
    e.create_pivot("m", "p", [("unit", "units"), ("line", "lines")], "line")
    e.set_value("m", "p", {"unit": "w", "line": "goal"}, 1000)
    e.set_rules("m", "p", "goal = goal[unit=@unit.parent] * unit.pct")
    return rounded(e.wide("m", "p"), 6)


@query("q_hierarchy_children", UNITS + " select u.id as unit, u.pct * 100 as own, round(coalesce((select sum(c.pct * 100) from u c where c.parent = u.id), 0), 6) + 0.0 as subs from u")
def q_hierarchy_children(spark, d):
    e = units(spark, d)
    lines(e, "lines", "own", "subs")
    e.create_pivot("m", "p", [("unit", "units"), ("line", "lines")], "line")
    e.set_rules("m", "p", "own = unit.pct * 100\nsubs = SUM(own[unit.parent=@unit])")
    return e.wide("m", "p").select("unit", "own", (F.round("subs", 6) + 0.0).alias("subs"))


@query("q_fixed_point", f"""
with recursive {PERIODS}, r as (
  select n_nationkey as nk, 0 as idx, 1000.0::double as debt, (600.0 + n_nationkey)::double as cash, 0.0::double as borrow from nation
  union all select nk, idx + 1, debt + b, cash + 10 - 0.07 * (debt + debt + b) / 2 - 60 + b, b
  from (select *, greatest(0, (501 - cash - 10 + 60 + 0.07 * debt) / (1 - 0.035)) as b from r where idx < 11)
) select nk::varchar as nation, period, round(debt, 2) + 0.0 as debt, round(cash, 2) + 0.0 as cash, round(borrow, 2) + 0.0 as borrow from r join per on r.idx = per.idx""")
def q_fixed_point(spark, d):
    e = star(spark, d, "region", "nation")
    e.set_iterate("m", {"max_iterations": 100, "tolerance": 1e-10})
    lines(e, "lines", "interest", "borrow", "debt", "cash")
    e.create_periods("m", "year", "1995-01", 12, "month")
    e.create_pivot("m", "fin", [("nation", "nation"), ("line", "lines"), ("period", "year")], "line", "period")
    e.set_rules("m", "fin", "interest = 0.07 * (PREV(debt) + debt) / 2\ninterest[period=jan95] = 0\nborrow = MAX(0, 501 - (PREV(cash) + 10 - interest - 60))\nborrow[period=jan95] = 0\ndebt = PREV(debt) + borrow\ndebt[period=jan95] = 1000\ncash = PREV(cash) + 10 - interest - 60 + borrow\ncash[period=jan95] = 600 + VALUE(@nation)")
    return rounded(e.wide("m", "fin").drop("interest"), 2)


@query("q_errors", """
select c_custkey::varchar as id, case when c_custkey % 5 = 0 then null else round(c_acctbal / (c_custkey % 5), 6) + 0.0 end as ratio, case when c_custkey % 5 = 0 then -1 else round(c_acctbal / (c_custkey % 5), 6) + 0.0 end as safe, (c_custkey % 5 = 0) as failed from customer""")
def q_errors(spark, d):
    e = star(spark, d, "region", "nation", "customer")
    for f, t in (("ratio", "number"), ("safe", "number"), ("failed", "bool")):
        e.add_field("m", "customer", {"id": f, "type": t, "computed": True})
    e.set_rules("m", "customer", "ratio = balance / MOD(VALUE(id), 5)\nsafe = IFERROR(balance / MOD(VALUE(id), 5), -1)\nfailed = ISERROR(ratio)")
    return rounded(e.table("m", "customer").select("id", "ratio", "safe", "failed"), 6)


@query("q_cell_errors", SALES + " select error, count(*) as n from (select case when k = 0 then 'DIV0' end as error from x) where error is not null group by 1")
def q_cell_errors(spark, d):
    return grid.error_summary(sales(spark, d, "n = COUNT(orders.total)\nratio = SUM(orders.total) / n", "n", "ratio"), "m", "sales")


for _grain, _step, _count in (("month", 1, 30), ("quarter", 3, 14), ("year", 12, 6)):

    @query(f"q_periods_{_grain}", f"""
with p as (select i, (date '1999-11-01' + to_months((i * {_step})::int))::date as s, ((date '1999-11-01' + to_months(((i + 1) * {_step})::int))::date - 1) as e from range({_count}) t(i))
select {dict(month="lower(strftime(s, '%b%y'))", quarter="'q' || quarter(e) || '_' || year(e)", year="'fy' || year(e)")[_grain]} as id, s as start, e as "end", case when e <= date '2000-12-31' then 'hist' else 'fcst' end as frame, year(e)::double as year, quarter(e)::double as quarter, i::double as idx from p""")
    def q_periods(spark, d, grain=_grain, count=_count):
        return calendar.periods(spark, "1999-11", count, grain, "2000-12-31").drop(ORD, "name")


@query("q_period_of_date", f"with {PERIODS} select o_orderkey::varchar as id, period from orders left join per on date_trunc('month', o_orderdate)::date = start")
def q_period_of_date(spark, d):
    return star(spark, d, "region", "nation", "customer", "orders").table("m", "orders").select("id", "period")


@query("q_period_as_of", """
with b as (select i, (date '1995-01-10' + (i * 100)::int)::date as s, (date '1995-01-10' + ((i + 1) * 100 - 11)::int)::date as e from range(20) t(i))
select o_orderkey::varchar as id, 'b' || i as bucket from orders left join b on o_orderdate::date between s and e""")
def q_period_as_of(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    start = F.date_add(F.lit("1995-01-10").cast("date"), (F.col("id") * 100).cast("int"))
    b = spark.range(20).select(F.concat(F.lit("b"), "id").alias("id"), start.alias("start"), F.date_add(start, 89).alias("end"), F.col("id").alias(ORD))
    e.create_table("m", "buckets", {"start": "date", "end": "date"}, df=b)
    e.add_field("m", "orders", {"id": "bucket", "ref": "buckets", "computed": True})
    e.set_rules("m", "orders", "bucket = PERIOD(date, buckets)", replace=False)
    return e.table("m", "orders").select("id", "bucket")


@query("q_distinct_dim", "select c_mktsegment as id, (row_number() over (order by min(c_custkey)) - 1)::bigint as place from customer group by 1")
def q_distinct_dim(spark, d):
    from pyspark.sql import Window

    out = merge.distinct_dimension(star(spark, d, "region", "nation", "customer").table("m", "customer"), "segment")
    return out.select("id", (F.row_number().over(Window.orderBy(ORD)) - 1).cast("long").alias("place"))


@query("q_rows_where", "select c_custkey::varchar as id, c_acctbal as balance from customer where c_acctbal >= 1000 and c_acctbal < 5000 and lower(c_mktsegment) in ('building', 'machinery') and contains(lower(c_name), '1') and c_nationkey <> 7")
def q_rows_where(spark, d):
    t = star(spark, d, "region", "nation", "customer").table("m", "customer")
    return rows.find_rows(t, {"balance": {"gte": 1000, "lt": 5000}, "segment": ["Building", "machinery"], "name": {"contains": "1"}, "nation": {"ne": "7"}}).select("id", "balance")


@query("q_rows_search", "select s_suppkey::varchar as id from supplier where contains(s_suppkey::varchar, '7') or contains(lower(s_name), '7') or contains(s_nationkey::varchar, '7') or contains(s_acctbal::varchar, '7')")
def q_rows_search(spark, d):
    return rows.find_rows(star(spark, d, "region", "nation", "supplier").table("m", "supplier"), q="7").select("id")


@query("q_rows_sort_page", "select id, rank from (select c_custkey::varchar as id, row_number() over (order by lower(c_mktsegment), c_acctbal desc, c_custkey) as rank from customer) where rank > 20 and rank <= 70")
def q_rows_sort_page(spark, d):
    from pyspark.sql import Window

    t = star(spark, d, "region", "nation", "customer").table("m", "customer")
    page = rows.find_rows(t, sort="segment,-balance", offset=20, limit=50)
    w = Window.orderBy(F.lower("segment"), F.desc("balance"), ORD)
    return page.select("id", (F.row_number().over(w) + 20).alias("rank"))


@query("q_grid_top", SALES + " select nation, round(jan95, 2) + 0.0 as jan95, round(feb95, 2) + 0.0 as feb95 from (select nation, nk, sum(case when period = 'jan95' then v end) as jan95, sum(case when period = 'feb95' then v end) as feb95 from x group by all) order by jan95 desc, nk limit 7")
def q_grid_top(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    return rounded(grid.grid_frame(e, "m", "sales", ["nation"], ["period"], {"line": "amount"}, {"period": ["jan95", "feb95"]}, {"by": "jan95", "desc": True}, 7))


@query("q_grid_attr_filter", SALES + " select nation, round(v, 2) + 0.0 as amount from x where rk in (1, 2) and period = 'mar96'")
def q_grid_attr_filter(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    df = grid.grid_cells(e, "m", "sales", {"line": "amount", "period": "mar96"}, {"nation": {"attr": "region", "in": ["1", "2"]}}, ["nation"])
    return rounded(df.select("nation", F.col("value").alias("amount")))


def _changed(spark, d, t):
    """Every third customer with a new balance, and as many new ones."""
    c = t.filter(F.pmod(F.col("id").cast("long"), F.lit(3)) == 0)
    return c.select("id", (F.col("balance") + 1).alias("balance")).union(c.select(F.concat(F.lit("new"), "id"), F.lit(5.0)))


@query("q_upsert", """
select c_custkey::varchar as id, c_name as name, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as balance from customer
union all select 'new' || c_custkey, null, 5.0 from customer where c_custkey % 3 = 0""")
def q_upsert(spark, d):
    e = star(spark, d, "region", "nation", "customer")
    e.upsert_rows("m", "customer", _changed(spark, d, e.table("m", "customer")))
    return e.table("m", "customer").select("id", "name", "balance")


@query("q_replace", """
select c_custkey::varchar as id, c_name as name, c_acctbal + 1 as balance from customer where c_custkey % 3 = 0
union all select 'new' || c_custkey, null, 5.0 from customer where c_custkey % 3 = 0""")
def q_replace(spark, d):
    e = star(spark, d, "region", "nation", "customer")
    e.upsert_rows("m", "customer", _changed(spark, d, e.table("m", "customer")), replace=True)
    return e.table("m", "customer").select("id", "name", "balance")


@query("q_upsert_changes", "select case when c_custkey % 2 = 0 then c_custkey::varchar else 'new' || c_custkey end as id, c_custkey % 2 = 1 as inserted, c_custkey % 4 = 0 as changed from customer")
def q_upsert_changes(spark, d):
    t = star(spark, d, "region", "nation", "customer").table("m", "customer")
    n = F.col("id").cast("long")
    new = t.select(F.when(n % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("new"), "id")).alias("id"), F.when(n % 4 == 0, F.col("balance") + 1).otherwise(F.col("balance")).alias("balance"))
    return merge.changes(t, new, ["balance"])


@query("q_delete_nullout", "select c_custkey::varchar as id, case when c_nationkey in (3, 4) then null else c_nationkey::varchar end as nation from customer")
def q_delete_nullout(spark, d):
    e = star(spark, d, "region", "nation", "customer")
    e.delete_rows("m", "nation", ["3", "4"])
    return e.table("m", "customer").select("id", "nation")


@query("q_append_conflicts", "select c_custkey::varchar as id from customer where c_custkey % 10 = 0")
def q_append_conflicts(spark, d):
    t = star(spark, d, "region", "nation", "customer").table("m", "customer")
    n = F.col("id").cast("long")
    return merge.clashes(t, t.select(F.when(n % 10 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id")).alias("id")))


@query("q_fk_candidates", "select 'nation' as \"column\", 'nation' as \"table\"")
def q_fk_candidates(spark, d):
    e = star(spark, d, "region", "nation")
    t = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    del e.models["m"].tables["region"]
    found = delimited.reference_candidates(t, {"nation": "text", "segment": "text"}, e.model("m"))
    return spark.createDataFrame(list(found.items()), "column string, table string")


@query("q_profile", """
select 'balance' as "column", 'number' as type, count(distinct c_acctbal)::bigint as "distinct", 0::bigint as nulls from customer union all
select 'segment', 'text', count(distinct lower(c_mktsegment)), 0 from customer union all
select 'share', 'number', count(distinct c_custkey % 50), 0 from customer union all
select 'since', 'date', count(distinct c_custkey % 28), 0 from customer union all
select 'some', 'bool', 2, count(*) filter (where c_custkey % 3 = 2) from customer""")
def q_profile(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    t = c.select(
        F.format_string("%.2f", "c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.concat(F.col("c_custkey") % 50, F.lit("%")).alias("share"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd").alias("since"),
        F.when(F.col("c_custkey") % 3 == 0, "yes").when(F.col("c_custkey") % 3 == 1, "No").alias("some"), F.monotonically_increasing_id().alias(ORD),
    )
    return delimited.profile(t).drop("samples")


def table_rules(spark, d, fields: dict, rules: str) -> DataFrame:
    e = star(spark, d, "region", "nation", "customer", "orders")
    for f, t in fields.items():
        e.add_field("m", "orders", {"id": f, "type": t, "computed": True})
    e.set_rules("m", "orders", rules)
    return e.table("m", "orders").select("id", *fields)


@query("q_math", """
select o_orderkey::varchar as id, round(sqrt(o_totalprice), 6) + 0.0 as root, round(ln(o_totalprice), 9) + 0.0 as log, round(exp(o_orderkey % 7), 6) + 0.0 as e, (case when o_orderkey % 10 = 0 then -5.0 else 5.0 end) - 3 * floor((case when o_orderkey % 10 = 0 then -5.0 else 5.0 end) / 3) as mod,
  ceil(o_totalprice / 100) * 100 as up, floor(o_totalprice / 100) * 100 as down, floor(o_totalprice / 250 + 0.5) * 250 as near, power(2, o_orderkey % 11) as pow, greatest(0, least(o_totalprice, 150000.0)) as clamp, -4.0 * -1 as neg, round(o_totalprice * 0.12, 4) + 0.0 as pct from orders""")
def q_math(spark, d):
    names = "root log e mod up down near pow clamp neg pct".split()
    out = table_rules(spark, d, dict.fromkeys(names, "number"), """
        root = SQRT(total)
        log = LN(total)
        e = EXP(MOD(VALUE(id), 7))
        mod = MOD(IF(MOD(VALUE(id), 10) = 0, -5, 5), 3)
        up = ROUNDUP(total, -2)
        down = ROUNDDOWN(total, -2)
        near = MROUND(total, 250)
        pow = 2 ^ MOD(VALUE(id), 11)
        clamp = MAX(0, MIN(total, 150000))
        neg = -2^2 * 1 + 0 * SIGN(total)
        pct = total * 12%""")
    return rounded(out, 6).withColumn("log", F.round("log", 6) + 0.0).withColumn("pct", F.round("pct", 4) + 0.0)


SQL["q_math"] = SQL["q_math"].replace("round(ln(o_totalprice), 9)", "round(ln(o_totalprice), 6)")


@query("q_text", """
select o_orderkey::varchar as id, left(o_orderpriority, 3) as l, right(o_orderpriority, 2) as r, substr(o_orderpriority, 3, 4) as m, length(o_orderpriority)::double as n, lower(o_orderpriority) as lo, upper(o_orderpriority || 'x') as up, replace(o_orderpriority, '-', ' to ') as sub,
  o_orderstatus || '/' || (o_orderkey % 3) as cat, contains(lower(o_orderpriority), 'urg') as has, lower(o_orderstatus) = 'o' as eq, starts_with(lower(o_orderpriority), '1-u') as st, 'a b' as tr, o_orderpriority[1:1] || '*' || substr(o_orderpriority, 4) as rep from orders""")
def q_text(spark, d):
    kinds = dict(l="text", r="text", m="text", n="number", lo="text", up="text", sub="text", cat="text", has="bool", eq="bool", st="bool", tr="text", rep="text")
    return table_rules(spark, d, kinds, """
        l = LEFT(priority, 3)
        r = RIGHT(priority, 2)
        m = MID(priority, 3, 4)
        n = LEN(priority)
        lo = LOWER(priority)
        up = UPPER(priority & "x")
        sub = SUBSTITUTE(priority, "-", " to ")
        cat = CONCAT(status, "/", MOD(VALUE(id), 3))
        has = CONTAINS(priority, "URG")
        eq = status = "o"
        st = STARTSWITH(priority, "1-u")
        tr = TRIM("  a   b ")
        rep = REPLACE(priority, 2, 2, "*")""")


@query("q_dates", """
select o_orderkey::varchar as id, year(d)::double as y, month(d)::double as mo, day(d)::double as da, quarter(d)::double as q, (dayofweek(d) + 1)::double as wd, last_day(d) as eom, (date_trunc('month', d) + interval 2 month)::date as som, (make_date(year(d), 1, 1) + interval (month(d) + 12) month)::date + 4 as mk,
  (d - date '1995-01-01')::double as days, strftime(d, '%Y-%m-%d') as iso, round((d - date '1995-01-01') / 365.0, 9) + 0.0 as yf, (date_diff('year', date '1995-06-15', d) - case when (month(d), day(d)) < (6, 15) then 1 else 0 end)::double as full_years from (select o_orderkey, o_orderdate::date as d from orders)""")
def q_dates(spark, d):
    kinds = dict(y="number", mo="number", da="number", q="number", wd="number", eom="date", som="date", mk="date", days="number", iso="text", yf="number", full_years="number")
    return rounded(table_rules(spark, d, kinds, """
        y = YEAR(date)
        mo = MONTH(date)
        da = DAY(date)
        q = QUARTER(date)
        wd = WEEKDAY(date)
        eom = EOMONTH(date)
        som = SOMONTH(date, 2)
        mk = DATE(YEAR(date), MONTH(date) + 13, 5)
        days = DAYS(date, DATE(1995, 1, 1))
        iso = DATEISO(date)
        yf = YEARFRAC(DATE(1995, 1, 1), date)
        full_years = DATEDIF(DATE(1995, 6, 15), date, "y")"""), 9)


@query("q_finance", """
with x as (select o_orderkey::varchar as id, o_totalprice as p, 0.01 + (o_orderkey % 5) / 100.0 as r, 12.0 + o_orderkey % 24 as n from orders), y as (select *, -(r * p * power(1 + r, n)) / (power(1 + r, n) - 1) as pay from x)
select id, round(pay, 3) + 0.0 as pay, round(-(100 * (power(1 + r, n) - 1) / r) / power(1 + r, n), 6) + 0.0 as pv, round(-(p * power(1 + r, n) + 100 * (power(1 + r, n) - 1) / r), 3) + 0.0 as fv, round((p - 100) / n, 8) + 0.0 as sln, round((p - 100) * (n - 2) * 2 / (n * (n + 1)), 9) + 0.0 as syd,
  round(-(p * power(1 + r, 2) + pay * (power(1 + r, 2) - 1) / r) * r, 3) + 0.0 as ip, round(pay + (p * power(1 + r, 2) + pay * (power(1 + r, 2) - 1) / r) * r, 3) + 0.0 as pp, round(n, 6) + 0.0 as periods, round(p * power(1 + r, 3), 4) + 0.0 as grown, round(p * 2 / (n + 0.3) * power(1 - 2 / (n + 0.3), 2), 2) + 0.0 as ddb from y""")
def q_finance(spark, d):
    names = "r n pay pv fv sln syd ip pp periods grown ddb".split()
    out = table_rules(spark, d, dict.fromkeys(names, "number"), """
        r = 0.01 + MOD(VALUE(id), 5) / 100
        n = 12 + MOD(VALUE(id), 24)
        pay = PMT(r, n, total)
        pv = PV(r, n, 100)
        fv = FV(r, n, 100, total)
        sln = SLN(total, 100, n)
        syd = SYD(total, 100, n, 3)
        ip = IPMT(r, 3, n, total)
        pp = PPMT(r, 3, n, total)
        periods = NPER(r, pay, total)
        grown = GROWTH(total, r, 3)
        ddb = DDB(total, 0, n + 0.3, 3)""")
    places = dict(pay=3, pv=6, fv=3, sln=8, syd=9, ip=3, pp=3, periods=6, grown=4, ddb=2)
    return out.select("id", *((F.round(c, p) + 0.0).alias(c) for c, p in places.items()))


@query("q_npv", SALES + " select nation, round(sum(v / power(1.01, idx + 1)), 2) + 0.0 as npv from x group by nation")
def q_npv(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    lines(e, "value_lines", "npv")
    e.create_pivot("m", "worth", [("nation", "nation"), ("line", "value_lines")], "line")
    e.set_rules("m", "worth", "npv = NPV(1%, sales.amount[period=all])")
    return rounded(e.wide("m", "worth"))


@query("q_irr", "select n_nationkey::varchar as nation, round(0.02 + n_nationkey / 1000.0, 9) + 0.0 as irr from nation")
def q_irr(spark, d):
    e = star(spark, d, "region", "nation")
    lines(e, "lines", "flow")
    lines(e, "value_lines", "irr")
    e.create_periods("m", "years", "2020-01", 3, "year")
    e.create_pivot("m", "flows", [("nation", "nation"), ("line", "lines"), ("period", "years")], "line", "period")
    e.set_rules("m", "flows", "flow = 0\nflow[period=fy2020] = -100\nflow[period=fy2022] = 100 * (1.02 + VALUE(@nation) / 1000) ^ 2")
    e.create_pivot("m", "worth", [("nation", "nation"), ("line", "value_lines")], "line")
    e.set_rules("m", "worth", "irr = IRR(flows.flow[period=all])")
    return rounded(e.wide("m", "worth"), 9)


@query("q_top_sum_records", """
with r as (select o_custkey, o_orderdate, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders)
select o_custkey::varchar as customer, arg_min(o_orderkey, k)::varchar as latest, round(sum(o_totalprice), 2) + 0.0 as total from r where k <= 4 group by 1""")
def q_top_sum_records(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = o.select(F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("string").alias("latest"), F.col("o_totalprice").alias("total"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return rounded(records.reduce_records(t, ["customer"], "at", 4, sums=["total"]).drop("at"))


@query("q_json_records", "select event_id, event_type as kind, round(cast(json_extract(props, '$.k') as double) / 10, 4) + 0.0 as k, 'e_' || event_id as id from events")
def q_json_records(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    bodies = ev.select("event_id", F.to_json(F.array(F.struct(F.col("event_type").alias("kind"), F.from_json("props", "map<string,string>").alias("p"), F.col("event_id").cast("string").alias("n_")))).alias("body"))
    got = records.map_records(records.json_records(bodies), {"kind": "kind", "k": ("p.k", "number"), "n_": "n_"}, scale=10, id="e_{n_}")
    return rounded(got.select("event_id", "kind", "k", "id"), 4)


@query("q_maintained_aggregate", "select c_nationkey::varchar as nation, round(sum(case when c_custkey % 11 = 0 then c_acctbal * 2 else c_acctbal end), 2) + 0.0 as total, count(*)::bigint as n from customer where c_custkey % 13 <> 0 group by 1")
def q_maintained_aggregate(spark, d):
    t = star(spark, d, "region", "nation", "customer").table("m", "customer").select("nation", "id", "balance")
    n = F.col("id").cast("long")
    after = t.filter(n % 13 != 0).withColumn("balance", F.when(n % 11 == 0, F.col("balance") * 2).otherwise(F.col("balance")))
    start = t.select("nation", F.col("balance").alias("value"), F.lit(1).cast("long").alias("sign"))
    delta = feeds.signed_changes(t, after, ["nation", "id"], "balance").select("nation", "value", "sign")
    return rounded(feeds.maintained(start.unionByName(delta), ["nation"]).select("nation", "total", "n"))


@query("q_event_windows", "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*)::bigint as n, round(sum(value), 4) + 0.0 as total from events group by all")
def q_event_windows(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return rounded(feeds.windowed(ev, "ts", "1 hour", "6 hours", by=["event_type"]), 4)


@query("q_event_sessions", """
with g as (select user_id, ts, case when ts > lag(ts) over w + interval 2 hour or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 2 hour as "end", count(*)::bigint as n from s group by user_id, k""")
def q_event_sessions(spark, d):
    return feeds.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "1 hour", "2 hours", ["user_id"])


@query("q_supplier_cube", """
with s as (select s_nationkey as n, p_brand as b, sum(l_extendedprice * (1 - l_discount)) as v, sum(l_quantity) as q from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by all)
select n_nationkey::varchar as nation, b.b as brand, round(coalesce(v, 0), 4) + 0.0 as net, coalesce(q, 0)::double as quantity, case when coalesce(q, 0) = 0 then null else round(v / q, 6) + 0.0 end as price
from nation cross join (select distinct p_brand as b from part) b left join s on s.n = n_nationkey and s.b = b.b""")
def q_supplier_cube(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders", "supplier", "part", "lineitem")
    e.add_field("m", "lineitem", {"id": "net", "type": "number", "computed": True})
    e.set_rules("m", "lineitem", "net = price * (1 - discount)")
    e.create_distinct("m", "brands", "part", "brand")
    lines(e, "lines", "net", "quantity", "price")
    e.create_pivot("m", "cube", [("nation", "nation"), ("brand", "brands"), ("line", "lines")], "line")
    e.set_rules("m", "cube", "net = SUM(lineitem.net[supplier.nation=@nation, part.brand=@brand])\nquantity = SUM(lineitem.quantity[supplier.nation=@nation, part.brand=@brand])\nprice = net / quantity")
    return e.wide("m", "cube").select("nation", "brand", (F.round("net", 4) + 0.0).alias("net"), "quantity", (F.round("price", 6) + 0.0).alias("price"))


@query("q_histogram", """
with e as (select min(l_extendedprice) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lineitem)
select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*)::bigint as n, round(sum(l_extendedprice), 2) + 0.0 as total from lineitem cross join e group by 1""")
def q_histogram(spark, d):
    from .operators import distribution

    return rounded(distribution.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice").select("bin", "n", "total"))


@query("q_quantile_groups", """
with b as (select quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) as b from customer)
select (len(list_filter(b, lambda x: x < c_acctbal)) + 1)::int as grp, count(*)::bigint as n, min(c_acctbal) as low, max(c_acctbal) as high, round(sum(c_acctbal), 2) + 0.0 as total from customer cross join b group by 1""")
def q_quantile_groups(spark, d):
    from .operators import distribution

    return rounded(distribution.quantile_groups(spark.read.parquet(f"{d}/customer.parquet"), "c_acctbal", 5))


@query("q_cross_model", SALES + " select nk::varchar as nation, round(sum(v) * 2, 2) + 0.0 as twice from x group by nk")
def q_cross_model(spark, d):
    e = sales(spark, d, "amount = SUM(orders.total)", "amount")
    e.create_model("other")
    e.models["other"].tables["nation"] = e.models["m"].tables["nation"]
    e.create_table("other", "lines", {}, [{"id": "twice"}])
    e.create_pivot("other", "p", [("nation", "nation"), ("line", "lines")], "line")
    e.set_rules("other", "p", "twice = SUM(m.sales.amount[period=all]) * 2")
    return rounded(e.wide("other", "p"))


@query("q_cohort_retention", """
with f as (select o_custkey, date_trunc('year', min(o_orderdate)) as c from orders group by 1),
a as (select distinct o_custkey, date_trunc('year', o_orderdate) as y from orders)
select 'fy' || year(c) as cohort, 'fy' || year(y) as year, count(*)::double as active from f join a using (o_custkey) group by all""")
def q_cohort_retention(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    first = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.year(F.min("o_orderdate")).alias("y"))
    e.create_periods("m", "years", "1995-01", 7, "year")
    e.create_periods("m", "cohorts", "1995-01", 7, "year")
    e.create_table("m", "joined", {"cohort": "ref:cohorts"}, df=first.select("id", F.concat(F.lit("fy"), "y").alias("cohort"), F.col("id").cast("long").alias(ORD)))
    e.add_field("m", "orders", {"id": "year", "ref": "years", "computed": True})
    e.add_field("m", "orders", {"id": "member", "ref": "joined", "computed": True})
    e.set_rules("m", "orders", "year = PERIOD(date, years)\nmember = customer.id", replace=False)
    e.create_table("m", "lines", {}, [{"id": "active"}])
    e.create_pivot("m", "p", [("cohort", "cohorts"), ("line", "lines"), ("year", "years")], "line")
    e.set_rules("m", "p", "active = COUNTD(orders.customer[member.cohort=@cohort])")
    return e.wide("m", "p").filter("active > 0")


@query("q_logic", """
select o_orderkey::varchar as id, (o_totalprice > 100000 and o_orderstatus = 'F') as both, (o_totalprice > 300000 or o_orderstatus = 'P' or not (o_totalprice > 1000)) as any, o_orderstatus = 'P' as empty, true as num, true as txt, true as logical,
  case when o_orderstatus = 'P' then -1.0 else round(o_totalprice, 2) + 0.0 end as first, (o_orderstatus = 'O' and (o_totalprice < 50000 or o_orderkey % 2 = 1)) as mixed from orders""")
def q_logic(spark, d):
    kinds = dict.fromkeys("both any empty num txt logical mixed".split(), "bool") | {"first": "number"}
    return rounded(table_rules(spark, d, kinds, """
        both = AND(total > 100000, status = "F")
        any = OR(total > 300000, status = "P", NOT(total > 1000))
        empty = ISBLANK(IF(status = "P", BLANK, status))
        num = ISNUMBER(total)
        txt = ISTEXT(priority)
        logical = ISLOGICAL(total > 1)
        first = COALESCE(IF(status = "P", BLANK, total), -1)
        mixed = status = "O" and (total < 50000 or not MOD(VALUE(id), 2) = 0)"""), 2)


@query("q_more_math", """
select o_orderkey::varchar as id, round(abs(150000 - o_totalprice), 4) + 0.0 as dist, round(log10(o_totalprice), 6) + 0.0 as digits, round(ln(o_totalprice) / ln(2), 6) + 0.0 as bits, power(o_orderkey % 5, 3) as cube, floor(o_totalprice / 10 + 0.5) * 10 as tens, floor(o_totalprice) as whole,
  case when o_orderkey % 3 > 0 then round(o_totalprice / (o_orderkey % 3), 4) + 0.0 end as part, true as dice, true as unit, true as today from orders""")
def q_more_math(spark, d):
    kinds = dict.fromkeys("dist digits bits cube tens whole part".split(), "number") | dict.fromkeys(("dice", "unit", "today"), "bool")
    out = table_rules(spark, d, kinds, """
        dist = ABS(150000 - total)
        digits = LOG10(total)
        bits = LOG(total, 2)
        cube = POWER(MOD(VALUE(id), 5), 3)
        tens = ROUND(total, -1)
        whole = TRUNC(total)
        part = IF(MOD(VALUE(id), 3) = 0, BLANK, DIVIDE(total, MOD(VALUE(id), 3)))
        dice = AND(RANDBETWEEN(1, 6) >= 1, RANDBETWEEN(1, 6) <= 6)
        unit = AND(RAND() >= 0, RAND() < 1)
        today = YEAR(TODAY()) > 2000""")
    return rounded(out, 6).withColumns({c: F.round(c, 4) + 0.0 for c in ("dist", "part")})


@query("q_more_text", """
select o_orderkey::varchar as id, ends_with(lower(o_orderpriority), 'ent') as ends, o_orderstatus = 'o' as exact, (o_orderkey % 12)::varchar || '!' as shown from orders""")
def q_more_text(spark, d):
    return table_rules(spark, d, {"ends": "bool", "exact": "bool", "shown": "text"}, """
        ends = ENDSWITH(priority, "ENT")
        exact = EXACT(status, "o")
        shown = STRING(MOD(VALUE(id), 12)) & "!\"""")


@query("q_period_overlap", """
with sp as (select 'y' || i as span, make_date((1992 + i)::int, 1, 1) as s, make_date((1992 + i)::int, 11, 30) as e from range(8) t(i) union all select 's' || i, make_date((1992 + i)::int, 6, 1), make_date((1992 + i)::int, 6, 20) from range(8) t(i)),
o as (select o_orderkey::varchar as id, o_orderdate::date as d from orders)
select id, case when e >= d then span end as span from o asof left join sp on d >= s""")
def q_period_overlap(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    day = lambda m, n: F.make_date((F.lit(1992) + F.col("id")).cast("int"), F.lit(m), F.lit(n))
    some = lambda k, a, b, o: spark.range(8).select(F.concat(F.lit(k), "id").alias("id"), day(*a).alias("start"), day(*b).alias("end"), (F.col("id") + o).alias(ORD))
    e.create_table("m", "spans", {"start": "date", "end": "date"}, df=some("y", (1, 1), (11, 30), 0).union(some("s", (6, 1), (6, 20), 8)))
    e.add_field("m", "orders", {"id": "span", "ref": "spans", "computed": True})
    e.set_rules("m", "orders", "span = PERIOD(date, spans)", replace=False)
    return e.table("m", "orders").select("id", "span")


@query("q_row_ranges", """
select o_orderkey::varchar as id, round(avg(o_totalprice) over (w rows between 3 preceding and 1 following), 4) + 0.0 as mean, max(o_totalprice) over (w rows between current row and 20 following) as top, count(*) over (w rows between 5 preceding and 1 preceding)::double as before,
  round(coalesce(sum(o_totalprice) over (w rows between 1 following and 3 following), 0), 2) + 0.0 as next3 from orders window w as (order by o_orderkey)""")
def q_row_ranges(spark, d):
    out = table_rules(spark, d, dict.fromkeys(("mean", "top", "before", "next3"), "number"), """
        mean = AVG(total[row = this-3 .. this+1])
        top = MAX(total[row = this .. this+20])
        before = COUNT(total[row = this-5 .. this-1])
        next3 = SUM(total[row = this+1 .. this+3])""")
    return out.withColumns({"mean": F.round("mean", 4) + 0.0, "before": F.coalesce("before", F.lit(0.0)), "next3": F.round("next3", 2) + 0.0})


@query("q_rows_read_pivots", """
with n as (select c_nationkey, sum(o_totalprice) as t from orders join customer on c_custkey = o_custkey group by 1), a as (select avg(c_acctbal) as m from customer)
select c_custkey::varchar as id, round(coalesce(t, 0), 2) + 0.0 as around, round(c_acctbal - m, 6) + 0.0 as off from customer c left join n using (c_nationkey) cross join a""")
def q_rows_read_pivots(spark, d):
    e = star(spark, d, "region", "nation", "customer", "orders")
    lines(e, "lines", "bought")
    e.create_pivot("m", "by_nation", [("nation", "nation"), ("line", "lines")], "line")
    e.set_rules("m", "by_nation", "bought = SUM(orders.total[customer.nation=@nation])")
    for f in ("around", "off"):
        e.add_field("m", "customer", {"id": f, "type": "number", "computed": True})
    e.set_rules("m", "customer", "around = by_nation.bought[nation=@nation]\noff = balance - AVG(customer.balance)")
    return e.table("m", "customer").select("id", (F.round("around", 2) + 0.0).alias("around"), (F.round("off", 6) + 0.0).alias("off"))


@query("q_load_delimited", """
select c_custkey::varchar as id, c_name as name, c_acctbal as balance, c_acctbal > 0 as in_credit, date '2020-01-01' + (c_custkey % 900)::int as since from customer""")
def q_load_delimited(spark, d):
    """A table from a delimited file: headers slugged, types told from the values, rows checked."""
    from .plans.cut import shared_path
    from .sources import delimited

    path = shared_path(spark, "delimited")
    c = spark.read.parquet(f"{d}/customer.parquet")
    since = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int"))
    c.select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias(" Name"), F.col("c_acctbal").alias("Balance"), (F.col("c_acctbal") > 0).alias("In Credit"), since.alias("Since")).write.csv(path, header=True, quoteAll=True)
    e = Engine(spark)
    e.create_model("m")
    delimited.load(e, "m", "clients", delimited.read_delimited(spark, path), id="cust_key")
    return e.table("m", "clients").select("id", "name", "balance", "in_credit", "since")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
