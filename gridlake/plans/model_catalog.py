"""Queries on formulas: models whose cells and formulas come from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import compile as C
from gridlake.functions import formula
from gridlake.operators import evaluate as E
from gridlake.operators import items as I
from gridlake.plans.registry import load, query


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with one row for each customer: A balance, B nation, C to E formulas on them."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("row"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    number = lambda k, v: F.struct(F.lit(k).alias("col_ix"), v.alias("v_num"), F.lit(None).cast("string").alias("formula_raw"))
    text = lambda k, f: F.struct(F.lit(k).alias("col_ix"), F.lit(None).cast("double").alias("v_num"), f.alias("formula_raw"))
    r = F.col("row").cast("string")
    cells = F.array(
        number(1, F.col("c_acctbal")), number(2, F.col("nation")), text(3, F.concat(F.lit("=ROUND(A"), r, F.lit("/3,2)"))),
        text(4, F.concat(F.lit("=IF(C"), r, F.lit(">2000,C"), r, F.lit("-A"), r, F.lit(",SUM(A"), r, F.lit(":C"), r, F.lit("))"))),
        text(5, F.concat(F.lit("=D"), r, F.lit("/B"), r)),
    )
    rows = c.select(F.lit("Data").alias("sheet"), "row", F.explode(cells).alias("x"))
    return E.with_ids(rows.select("sheet", "row", "x.col_ix", "x.v_num", F.lit(None).cast("string").alias("v_str"), "x.formula_raw"))


MODEL = """a AS (SELECT c_custkey AS k, c_acctbal AS a, c_nationkey::double AS b FROM customer), c AS (SELECT *, round_even(a / 3, 2) AS c FROM a),
d AS (SELECT *, CASE WHEN c > 2000 THEN c - a ELSE a + b + c END AS d FROM c)"""


@query(f"""
WITH {MODEL} SELECT 'Data!' || k || '!' || x.col AS id, round(x.num, 6) AS num, x.str AS str FROM (SELECT k, unnest([{{'col': 1, 'num': a, 'str': NULL}}, {{'col': 2, 'num': b, 'str': NULL}},
  {{'col': 3, 'num': c, 'str': NULL}}, {{'col': 4, 'num': d, 'str': NULL}}, {{'col': 5, 'num': CASE WHEN b <> 0 THEN d / b END, 'str': CASE WHEN b = 0 THEN '#DIV/0!' END}}]) AS x FROM d)
""")
def model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = E.evaluate(model(spark, sf_dir))
    return values.select("id", F.round("v_num", 6).alias("num"), F.col("v_str").alias("str"))


@query(f"""
WITH {MODEL}, e AS (SELECT min(k) AS k FROM a), n AS (SELECT d.k, d.a + 1000 AS a, d.b, d.c AS c0, d.d AS d0 FROM d JOIN e ON d.k = e.k),
n2 AS (SELECT *, round_even(a / 3, 2) AS c FROM n), n3 AS (SELECT *, CASE WHEN c > 2000 THEN c - a ELSE a + b + c END AS d FROM n2)
SELECT 'Data!' || k || '!' || x.col AS id, round(x.old, 6) AS old, round(x.new, 6) AS new FROM (SELECT k, unnest([{{'col': 3, 'old': c0, 'new': c}}, {{'col': 4, 'old': d0, 'new': d}},
  {{'col': 5, 'old': CASE WHEN b <> 0 THEN d0 / b END, 'new': CASE WHEN b <> 0 THEN d / b END}}]) AS x FROM n3) WHERE x.old <> x.new
""")
def model_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer's balance rises by 1000: which cells change."""
    cells = model(spark, sf_dir)
    stored = E.evaluate(cells)
    cells = cells.drop("v_num", "v_str").join(stored, "id").select("id", *E.KEY, "v_num", "v_str", "formula_raw")
    first = cells.where("col_ix = 1").agg(F.min_by(F.struct("id", "v_num"), "row").alias("x"))
    edits = first.select("x.id", (F.col("x.v_num") + 1000).alias("v_num"), F.lit(None).cast("string").alias("v_str"))
    changes = E.recalculate(cells, edits)
    return changes.select("id", F.round("old_num", 6).alias("old"), F.round("new_num", 6).alias("new"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_acctbal AS a, c_nationkey::double AS b, lead(c_nationkey::double) OVER (ORDER BY c_custkey) AS below, lead(c_custkey) OVER (ORDER BY c_custkey) AS next FROM customer)
SELECT k AS "row", CASE WHEN next = k + 1 THEN below END AS picked, round(a + 2 * b, 6) AS found FROM c
""")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INDEX and VLOOKUP by the evaluator on rectangles of two rows, beside a range of another width."""
    r, below = F.col("row").cast("string"), (F.col("row") + 1).cast("string")
    inputs = model(spark, sf_dir).where("col_ix <= 2").select(*E.KEY, "v_num", "v_str", "formula_raw")
    rows = inputs.where("col_ix = 1").select("sheet", "row")
    box = F.concat(F.lit("A"), r, F.lit(":B"), below)
    texts = {6: F.concat(F.lit("=INDEX("), box, F.lit(",2,2)")), 7: F.concat(F.lit("=SUM(A"), r, F.lit(":E"), r, F.lit(")+VLOOKUP(A"), r, F.lit(","), box, F.lit(",2,FALSE)"))}
    none = [F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("string").alias("v_str")]
    lookups = [rows.select("sheet", "row", F.lit(k).alias("col_ix"), *none, f.alias("formula_raw")) for k, f in texts.items()]
    values = E.evaluate(E.with_ids(inputs.unionByName(lookups[0]).unionByName(lookups[1])))
    at = F.split("id", "!")
    col = lambda k: F.max(F.when(at[2] == str(k), F.col("v_num")))
    return values.groupBy(at[1].cast("int").alias("row")).agg(col(6).alias("picked"), F.round(col(7), 6).alias("found"))


def _sheet(rows: DataFrame, sheet: str, row: str, columns: dict[int, F.Column]) -> DataFrame:
    """Cells of a sheet: for each row a cell in each of the columns, a number or, if the expression is text, a formula."""
    kinds = dict(rows.select(*[c.alias(str(k)) for k, c in columns.items()]).dtypes)
    cell = lambda k, c: F.struct(F.lit(k).alias("col_ix"), (F.lit(None) if kinds[str(k)] == "string" else c).cast("double").alias("v_num"), (c if kinds[str(k)] == "string" else F.lit(None)).cast("string").alias("formula_raw"))
    each = F.explode(F.array(*[cell(k, c) for k, c in columns.items()]))
    return E.with_ids(rows.select(F.lit(sheet).alias("sheet"), F.col(row).cast("int").alias("row"), each.alias("x")).select("sheet", "row", "x.col_ix", "x.v_num", F.lit(None).cast("string").alias("v_str"), "x.formula_raw"))


def _wide(values: DataFrame, sheet: str, columns: dict[int, str]) -> DataFrame:
    """row and the named columns of a sheet's values."""
    at = F.split("id", "!")
    picked = [F.max(F.when(at[2] == str(k), F.col("v_num"))).alias(c) for k, c in columns.items()]
    return values.where(at[0] == sheet).groupBy(at[1].cast("int").alias("row")).agg(*picked)


@query("""
WITH c AS (SELECT c_custkey + 1 AS k, c_acctbal::decimal(18,2) AS a, count(*) OVER w AS n, sum(c_acctbal::decimal(18,2)) OVER w AS total, max(c_acctbal) OVER w AS top, min(c_acctbal) OVER w AS low FROM customer WINDOW w AS (ORDER BY c_custkey))
SELECT k::int AS "row", round(total::double, 2) AS total, round(total::double, 2) / k AS mean, CASE WHEN n < k THEN greatest(top, 0) ELSE top END AS top, CASE WHEN n < k THEN least(low, 0) ELSE low END AS low, k::double AS n FROM c
""")
def running_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of all balances so far, a range from the first row to each: SUM(A$1:Ak), as in a year-to-date column."""
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("row"), "c_acctbal")
    upto = F.concat(F.lit("(A$1:A"), F.col("row").cast("string"), F.lit(")"))
    made = {k: F.concat(F.lit(f"={f}"), upto) for k, f in ((2, "SUM"), (4, "MAX"), (5, "MIN"), (6, "COUNT"))}
    # Rounded to cents in the model, so that the order of the sum does not show.
    made[2], made[3] = F.concat(F.lit("=ROUND(SUM"), upto, F.lit(",2)")), F.concat(F.lit("=ROUND(SUM"), upto, F.lit(",2)/COUNT"), upto)
    values = E.evaluate(_sheet(c, "Flow", "row", {1: F.col("c_acctbal"), **made}))
    return _wide(values, "Flow", {2: "total", 3: "mean", 4: "top", 5: "low", 6: "n"})


@query("""
SELECT (c_custkey + 1)::int AS "row", round((sum(c_acctbal::decimal(18,2)) OVER (ORDER BY c_custkey))::double, 2) AS closing FROM customer
""")
def roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing balances, each the one above plus the row's own: a chain as long as the table."""
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("row"), "c_acctbal")
    r = F.col("row").cast("string")
    above = F.when(F.col("row") > 1, F.concat(F.lit("=B"), (F.col("row") - 1).cast("string"), F.lit("+A"), r)).otherwise(F.concat(F.lit("=A"), r))
    values = E.evaluate(_sheet(c, "Roll", "row", {1: F.col("c_acctbal"), 2: above}))
    return _wide(values, "Roll", {2: "closing"}).select("row", F.round("closing", 2).alias("closing"))


@query("""
SELECT (c_custkey + 1)::int AS "row", round((c_acctbal + 0.5) / 0.75, 2) AS debt, round((c_acctbal + 2) / 1.5, 2) AS interest FROM customer
""")
def circular_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt that follows from interest that follows from debt: a cycle of two cells for each customer, all iterated together."""
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("row"), "c_acctbal")
    r = F.col("row").cast("string")
    debt, interest = F.concat(F.lit("=C"), r, F.lit("*0.5+A"), r), F.concat(F.lit("=B"), r, F.lit("*0.5+1"))
    values = E.evaluate(_sheet(c, "Loan", "row", {1: F.col("c_acctbal"), 2: debt, 3: interest}))
    return _wide(values, "Loan", {2: "debt", 3: "interest"}).select("row", F.round("debt", 2).alias("debt"), F.round("interest", 2).alias("interest"))


@query("""
WITH c AS (SELECT c_nationkey AS k, c_custkey + 1 AS c_custkey, c_acctbal::decimal(18,2) AS a FROM customer), t AS (SELECT k, sum(a)::double AS total, count(*)::double AS n, min(c_custkey)::double AS first FROM c GROUP BY 1)
SELECT (n_nationkey + 1)::int AS "row", round(coalesce(total, 0), 2) AS total, coalesce(t.n, 0) AS n, t.first AS first, (SELECT count(*) FROM c WHERE c.k <= n_nationkey)::double AS upto FROM nation LEFT JOIN t ON t.k = n_nationkey
""")
def nation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sheet that looks into whole columns of the first: sums and counts by nation, the first row of each, and a count by a comparison."""
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("row"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    last = c.agg(F.max("row")).first()[0] or 1
    n = load(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("row"), F.col("n_nationkey").cast("double").alias("nation"))
    a = F.concat(F.lit("A"), F.col("row").cast("string"))
    by, add = f"Data!$B$1:$B${last}", f"Data!$A$1:$A${last}"
    made = {2: F.concat(F.lit(f"=SUMIF({by},"), a, F.lit(f",{add})")), 3: F.concat(F.lit(f"=COUNTIF({by},"), a, F.lit(")")), 4: F.concat(F.lit("=MATCH("), a, F.lit(f",{by},0)")), 5: F.concat(F.lit(f'=COUNTIF({by},"<="&'), a, F.lit(")"))}
    cells = _sheet(c, "Data", "row", {1: F.col("c_acctbal"), 2: F.col("nation")}).unionByName(_sheet(n, "Totals", "row", {1: F.col("nation"), **made}))
    return _wide(E.evaluate(cells), "Totals", {2: "total", 3: "n", 4: "first", 5: "upto"}).withColumn("total", F.round("total", 2))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One formula for each part, of five forms, by the brand's last digit."""
    r, brand = F.col("p_partkey").cast("string"), F.substring("p_brand", -1, 1)
    form = (
        F.when(brand == "1", F.concat(F.lit("=SUM(A"), r, F.lit(":C"), r, F.lit(")+Data!B"), r))
        .when(brand == "2", F.concat(F.lit("=IF($A$1>0,B"), r, F.lit("*2,C"), r, F.lit("%)")))
        .when(brand == "3", F.concat(F.lit("=VLOOKUP(A"), r, F.lit(",'Price-List'!$A$1:$C$9,2,FALSE)&\"x\"")))
        .when(brand == "4", F.concat(F.lit("=NPV(A1,B"), r, F.lit(")")))
        .otherwise(F.concat(F.lit("=(A"), r, F.lit("+")))
    )
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), form.alias("formula_raw"), brand.alias("form"))


@query("""
WITH f AS (SELECT p_partkey AS id, right(p_brand, 1) AS form FROM part)
SELECT id, CASE form WHEN '1' THEN 2 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 2 ELSE 0 END::int AS n_refs, CASE WHEN form IN ('1', '3') THEN 1 ELSE 0 END::int AS n_ranges,
  CASE form WHEN '1' THEN 'Data' WHEN '3' THEN 'Price-List' END AS sheet, form NOT IN ('1', '2', '3', '4') AS failed FROM f
""")
def formula_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = formula.parsed(formulas(spark, sf_dir))
    ranges = F.size(F.filter("refs", lambda r: r["is_range"]))
    return p.select("id", F.size("refs").alias("n_refs"), ranges.alias("n_ranges"), F.array_max("refs.sheet").alias("sheet"), F.col("error").isNotNull().alias("failed"))


@query("""
WITH f AS (SELECT right(p_brand, 1) AS form FROM part)
SELECT count(*)::bigint AS total, count(*) FILTER (form IN ('1', '2', '3'))::bigint AS covered, count(*) FILTER (form NOT IN ('1', '2', '3'))::bigint AS fallback,
  round(100.0 * count(*) FILTER (form IN ('1', '2', '3')) / count(*), 4)::double AS percent, 'IF,NPV,SUM,VLOOKUP' AS functions FROM f
""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many formulas can be read and use known functions only."""
    p = formula.parsed(formulas(spark, sf_dir)).withColumn("calls", F.filter("program", lambda i: i["op"] == "call")["text"])
    known = F.forall("calls", lambda c: c.isin(*C.KNOWN))
    covered = F.col("error").isNull() & known
    n, all_ = F.count_if(covered), F.count(F.lit(1))
    return p.agg(
        all_.alias("total"), n.alias("covered"), F.count_if(~covered).alias("fallback"), F.round(n * 100.0 / all_, 4).alias("percent"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("calls")))), ",").alias("functions"),
    )


@query("""
SELECT p_partkey AS id, 'A' || p_partkey AS cells FROM part WHERE right(p_brand, 1) NOT IN ('1', '2', '3', '4')
""")
def formula_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that cannot be read still name cells."""
    p = formula.parsed(formulas(spark, sf_dir)).where("error IS NOT NULL")
    return p.select("id", F.array_join(formula.endpoints(F.col("formula_raw")), ",").alias("cells"))


@query("""
SELECT 'BI_Accounts_' || c_custkey AS item_id, c_name AS name, 'EUR' AS unit, 2 AS value_col, 2 AS ts_start, 6 AS ts_end, true AS has_time_series FROM customer
""")
def items_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a sheet: serial number, name, balance, unit and a series."""
    c = load(spark, sf_dir, "customer")
    number = lambda k, v: F.struct(F.lit(k).alias("col_ix"), v.cast("double").alias("v_num"), F.lit(None).cast("string").alias("v_str"))
    text = lambda k, v: F.struct(F.lit(k).alias("col_ix"), F.lit(None).cast("double").alias("v_num"), v.alias("v_str"))
    key, name, balance = F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal")
    row = F.array(number(2, key), text(3, name), number(4, balance), number(5, balance * 2), number(6, balance * 3), text(7, F.lit("EUR")))
    cells = c.select(F.lit("Accounts").alias("sheet"), key.cast("int").alias("row"), F.explode(row).alias("x")).select("sheet", "row", "x.*", F.lit(None).cast("string").alias("formula_raw"))
    return I.items(cells).select("item_id", "name", "unit", "value_col", "ts_start", "ts_end", "has_time_series")
