"""Queries that apply the function library to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.functions import coerce
from gridlake.functions import library as L
from gridlake.operators import lookup
from gridlake.plans.registry import load, money, query


@query("""
SELECT l_orderkey AS orderkey, sum(l_quantity)::double AS f_sum, min(l_quantity)::double AS f_min, max(l_quantity)::double AS f_max,
  round(sum(l_quantity) / count(*), 6) AS f_average, count(*)::bigint AS f_count
FROM lineitem GROUP BY 1
""")
def fn_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM, MIN, MAX, AVERAGE, COUNT of each order's quantities; partial aggregation, no arrays."""
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.sum(q).alias("f_sum"), F.min(q).alias("f_min"), F.max(q).alias("f_max"),
        F.round(F.sum(q) / F.count(F.lit(1)), 6).alias("f_average"), F.count(F.lit(1)).alias("f_count"),
    )


@query("""
WITH t AS (SELECT o_custkey, count(*)::double AS n, sum(o_totalprice::decimal(18,2))::double AS total, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT o_custkey AS custkey, round(n + total + top, 2) AS f_sum, greatest(n, total, top) AS f_max, least(n, total, top) AS f_min,
  3::bigint AS f_count, round((n + total + top) / 3, 4) AS f_average FROM t
""")
def fn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions over a range held as an array."""
    per = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"), F.max("o_totalprice").alias("top")
    )
    cells = F.array("n", "total", "top")
    return per.select(
        "custkey", F.round(L.SUM(cells), 2).alias("f_sum"), L.MAX(cells).alias("f_max"), L.MIN(cells).alias("f_min"),
        L.COUNT(cells).alias("f_count"), F.round(L.AVERAGE(cells), 4).alias("f_average"),
    )


@query("""
SELECT l_returnflag AS flag, count(*) FILTER (l_quantity >= 25)::bigint AS n_ge, count(*) FILTER (l_discount < 0.03)::bigint AS n_lt,
  count(*) FILTER (l_quantity <> 10)::bigint AS n_ne, count(*) FILTER (lower(l_linestatus) = 'o')::bigint AS n_open FROM lineitem GROUP BY 1
""")
def fn_countif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        L.COUNTIF(F.col("l_quantity"), ">=25").alias("n_ge"), L.COUNTIF(F.col("l_discount"), "<0.03").alias("n_lt"),
        L.COUNTIF(F.col("l_quantity"), "<>10").alias("n_ne"), L.COUNTIF(F.col("l_linestatus"), "O").alias("n_open"),
    )


@query("""
SELECT l_suppkey AS suppkey, sum(CASE WHEN l_quantity > 30 THEN l_extendedprice::decimal(18,2) END)::double AS big,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)::double AS returned FROM lineitem GROUP BY 1
""")
def fn_sumif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        L.SUMIF(F.col("l_quantity"), ">30", money("l_extendedprice")).cast("double").alias("big"),
        L.SUMIF(F.col("l_returnflag"), "R", F.col("l_quantity")).alias("returned"),
    )


@query("""
SELECT p_brand AS brand, count(*) FILTER (p_name LIKE '%a%')::bigint AS with_a, count(*) FILTER (p_type LIKE 'S%')::bigint AS s_types,
  count(*) FILTER (p_name LIKE '_a%')::bigint AS second_a FROM part GROUP BY 1
""")
def fn_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        L.COUNTIF(F.col("p_name"), "*a*").alias("with_a"), L.COUNTIF(F.col("p_type"), "S*").alias("s_types"), L.COUNTIF(F.col("p_name"), "?a*").alias("second_a")
    )


@query("""
SELECT o_orderkey AS orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS f_if,
  o_orderstatus = 'O' AND o_totalprice > 50000 AS f_and, o_orderstatus = 'F' OR o_totalprice < 1000 AS f_or, NOT (o_orderstatus = 'P') AS f_not,
  CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS f_default, o_orderpriority IS NULL OR o_orderpriority = '' AS f_isblank FROM orders
""")
def fn_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("o_orderstatus"), F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), L.IF(t > 100000, F.lit("large"), F.lit("small")).alias("f_if"), L.AND(s == "O", t > 50000).alias("f_and"),
        L.OR(s == "F", t < 1000).alias("f_or"), L.NOT(s == "P").alias("f_not"), L.IF(s == "O", F.lit(1)).alias("f_default"),
        L.ISBLANK(F.col("o_orderpriority")).alias("f_isblank"),
    )


@query("""
SELECT c_custkey AS custkey, ceil(c_acctbal * 10.0) / 10.0 AS f_up, floor(c_acctbal * 10.0) / 10.0 AS f_down, abs(c_acctbal) AS f_abs,
  trunc(c_acctbal)::bigint AS f_int, round(c_acctbal - 7 * floor(c_acctbal / 7), 6) AS f_mod, sign(c_acctbal)::int AS f_sign,
  CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS f_sqrt, round(pow(abs(c_acctbal) / 1000, 2), 6) AS f_power FROM customer
""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), L.ROUNDUP(x, 1).alias("f_up"), L.ROUNDDOWN(x, 1).alias("f_down"), L.ABS(x).alias("f_abs"),
        L.INT(x).alias("f_int"), F.round(L.MOD(x, F.lit(7.0)), 6).alias("f_mod"), L.SIGN(x).alias("f_sign"),
        F.round(L.SQRT(x), 6).alias("f_sqrt"), F.round(L.POWER(L.ABS(x) / 1000, F.lit(2)), 6).alias("f_power"),
    )


@query("SELECT l_quantity / 2 AS half, round_even(l_quantity / 2, 0)::double AS f_round, count(*)::bigint AS n FROM lineitem GROUP BY 1, 2")
def fn_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = (F.col("l_quantity") / 2).alias("half")
    return load(spark, sf_dir, "lineitem").groupBy(half).agg(F.count(F.lit(1)).alias("n")).select("half", L.ROUND(F.col("half"), 0).alias("f_round"), "n")


@query("""
SELECT o_orderkey AS orderkey, year(o_orderdate)::int AS f_year, month(o_orderdate)::int AS f_month, day(o_orderdate)::int AS f_day,
  date_diff('day', DATE '1899-12-30', o_orderdate::date)::int AS f_serial,
  make_date(year(o_orderdate)::int, month(o_orderdate)::int, 1)::varchar AS f_date FROM orders
""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by way of their serial numbers, so that both conversions are used."""
    d = L.to_date(L.serial(F.to_date("o_orderdate")).cast("string"))
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), L.YEAR(d).alias("f_year"), L.MONTH(d).alias("f_month"), L.DAY(d).alias("f_day"),
        L.serial(d).alias("f_serial"), L.DATE(L.YEAR(d), L.MONTH(d), F.lit(1)).cast("string").alias("f_date"),
    )


_MONTHS = "(year(e) - year(s)) * 12 + month(e) - month(s) - CASE WHEN day(e) < day(s) THEN 1 ELSE 0 END"


@query(f"""
WITH t AS (SELECT o_orderkey AS orderkey, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS price, o_orderdate::date AS s, l_shipdate::date AS e
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT orderkey, line, partkey, suppkey, price, date_diff('day', s, e)::int AS days, ({_MONTHS})::int AS months,
  (year(e) - year(s) - CASE WHEN month(e) * 100 + day(e) < month(s) * 100 + day(s) THEN 1 ELSE 0 END)::int AS years,
  ((({_MONTHS}) % 12 + 12) % 12)::int AS f_ym, date_diff('day', (s + to_months(({_MONTHS})::int))::date, e)::int AS f_md,
  date_diff('day', (s + to_months((12 * (year(e) - year(s) - CASE WHEN month(e) * 100 + day(e) < month(s) * 100 + day(s) THEN 1 ELSE 0 END))::int))::date, e)::int AS f_yd,
  date_diff('day', (e + to_months((({_MONTHS.replace('(s)', '(x)').replace('(e)', '(s)').replace('(x)', '(e)')}))::int))::date, s)::int AS f_md_back FROM t
""")
def fn_datedif(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    s, e = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_extendedprice").alias("price"), L.DATEDIF(s, e, "D").alias("days"), L.DATEDIF(s, e, "M").alias("months"),
        L.DATEDIF(s, e, "Y").alias("years"), L.DATEDIF(s, e, "YM").alias("f_ym"),
        L.DATEDIF(s, e, "MD").alias("f_md"), L.DATEDIF(s, e, "YD").alias("f_yd"), L.DATEDIF(e, s, "MD").alias("f_md_back"),
    )


@query("""
SELECT o_orderkey AS orderkey, date_diff('day', DATE '1899-12-30', (o_orderdate::date + INTERVAL 1 MONTH)::date)::int AS next_month,
  date_diff('day', DATE '1899-12-30', (o_orderdate::date + INTERVAL 18 MONTH)::date)::int AS later FROM orders
""")
def fn_edate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), L.EDATE(d, 1).alias("next_month"), L.EDATE(d, 18).alias("later"))


@query("""
SELECT p_partkey AS partkey, length(p_name)::int AS f_len, p_brand || '-' || p_type AS joined, p_name || ' ' || p_size::varchar AS labelled FROM part
""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), L.LEN(F.col("p_name")).alias("f_len"), L.CONCATENATE(F.col("p_brand"), F.lit("-"), F.col("p_type")).alias("joined"),
        L.CONCATENATE(F.col("p_name"), F.lit(" "), F.col("p_size")).alias("labelled"),
    )


@query("""
WITH t AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, value, user_id FROM events)
SELECT event_id, coalesce(try_cast(event_type AS double), 0) AS type_number, value + coalesce(try_cast(user_id::varchar AS double), 0) AS plus,
  CASE WHEN user_id % 7 <> 0 THEN value / (user_id % 7) END AS quotient, CASE WHEN user_id % 7 = 0 THEN '#DIV/0!' END AS error,
  lower(trim(event_type)) < 'd' AS before_d FROM t
""")
def coerce_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as numbers, division with its error value, comparison of texts."""
    rest = (F.col("user_id") % 7).cast("double")
    quotient, error = coerce.safe_divide(F.col("value"), rest)
    return load(spark, sf_dir, "events").select(
        "event_id", coerce.number(F.col("event_type")).alias("type_number"), (F.col("value") + coerce.number(F.col("user_id").cast("string"))).alias("plus"),
        quotient.alias("quotient"), error.alias("error"), coerce.compare("<", F.col("event_type"), F.lit("d")).alias("before_d"),
    )


@query("""
SELECT c_custkey AS custkey, round(-0.05 * c_acctbal * pow(1.05, 10) / (pow(1.05, 10) - 1), 6) AS payment, round(-c_acctbal / 12, 6) AS without_interest,
  round(-0.01 * (c_acctbal * pow(1.01, 24) + 100) / ((pow(1.01, 24) - 1) * 1.01), 6) AS in_advance FROM customer
""")
def fn_pmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.round(L.PMT(F.lit(0.05), F.lit(10), pv), 6).alias("payment"),
        F.round(L.PMT(F.lit(0.0), F.lit(12), pv), 6).alias("without_interest"), F.round(L.PMT(F.lit(0.01), F.lit(24), pv, 100.0, 1), 6).alias("in_advance"),
    )


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, days, flows: an outlay of nine tenths of what follows, then one inflow for each day with orders."""
    daily = load(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum(money("o_totalprice")).cast("double").alias("v"))
    per = daily.groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("f"), F.sum(money("v")).cast("double").alias("total"))
    first = F.date_sub(F.element_at("f.day", 1), 180)
    days = F.concat(F.array(L.serial(first).cast("double")), F.transform("f.day", lambda d: L.serial(d).cast("double")))
    return per.select("custkey", days.alias("days"), F.concat(F.array(F.col("total") * -0.9), F.col("f.v")).alias("flows"))


@query()
def fn_irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate, and what remains of the value at it: next to nothing."""
    found = _flows(spark, sf_dir).withColumn("rate", L.IRR("flows"))
    left = F.aggregate(F.transform("flows", lambda v, i: v / F.pow(1 + F.col("rate"), i)), F.lit(0.0), lambda a, v: a + v)
    return found.select("custkey", F.round("rate", 8).alias("rate"), F.round(left, 3).alias("left"), F.size("flows").alias("n"))


@query()
def fn_xirr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flows(spark, sf_dir).withColumn("rate", L.XIRR("flows", "days"))
    pairs = F.zip_with("flows", "days", lambda v, d: v * F.pow(1 + F.col("rate"), -(d - F.element_at("days", 1)) / 365.0))
    return found.select("custkey", F.round("rate", 8).alias("rate"), F.round(F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v), 3).alias("left"), F.size("flows").alias("n"))


@query("""
SELECT c_custkey AS custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VLOOKUP with an exact match is a left join."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("c_custkey").alias("custkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


@query("""
WITH bands AS (SELECT p_size AS size, min(p_retailprice) AS starts FROM part GROUP BY 1)
SELECT p_partkey AS partkey, (SELECT max(starts) FROM bands b WHERE b.starts <= p.p_retailprice) AS band_start,
  (SELECT min(size) FROM bands c WHERE c.starts = (SELECT max(starts) FROM bands b WHERE b.starts <= p.p_retailprice))::int AS band FROM part p
""")
def lookup_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VLOOKUP with an approximate match is an as-of join: keys and values in one order, dealt by ranges of it, the last key
    carried over the borders."""
    part = load(spark, sf_dir, "part")
    bands = part.groupBy(F.col("p_size").alias("size")).agg(F.min("p_retailprice").alias("price")).groupBy("price").agg(F.min("size").alias("size"))
    entries = bands.select(F.lit(0).alias("sheet"), "price", F.struct("price", "size").alias("band"))
    asked = part.select(F.lit(0).alias("sheet"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("partkey"))
    found = lookup.last_not_after(entries, asked, ["sheet"], "price", "band")
    return found.select("partkey", F.col("band.price").alias("band_start"), F.col("band.size").cast("int").alias("band"))


@query("""
SELECT vec_id, list_position(embedding, list_max(embedding))::bigint AS at_max, embedding[3]::double AS third, embedding[len(embedding) + 1]::double AS outside,
  CASE label % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS chosen FROM embeddings
""")
def index_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH, INDEX and CHOOSE over arrays."""
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", L.MATCH(F.array_max(v), v).cast("long").alias("at_max"), L.INDEX(v, F.lit(3)).cast("double").alias("third"),
        L.INDEX(v, F.size(v) + 1).cast("double").alias("outside"), L.CHOOSE(F.col("label") % 3 + 1, F.lit("low"), F.lit("mid"), F.lit("high")).alias("chosen"),
    )


@query("""
WITH m AS (SELECT l_suppkey AS suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS month, sum(l_extendedprice::decimal(18,2))::double AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT suppkey, month, v, max(v) OVER (PARTITION BY suppkey) AS top FROM m)
SELECT suppkey, count(*)::bigint AS months, (count(*) FILTER (v <= top / 2))::bigint AS below_half, max(CASE WHEN v <= top / 2 THEN month END)::int AS last_below FROM r GROUP BY 1
""")
def match_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH with kind 1 over each supplier's months: the last month not above half of the best one."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month")
    m = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), month).agg(F.sum(money("l_extendedprice")).cast("double").alias("v"))
    r = m.withColumn("half", F.max("v").over(Window.partitionBy("suppkey")) / 2)
    low = F.col("v") <= F.col("half")
    return r.groupBy("suppkey").agg(
        F.count(F.lit(1)).alias("months"), F.count_if(low).alias("below_half"), F.max(F.when(low, F.col("month"))).cast("int").alias("last_below")
    )
