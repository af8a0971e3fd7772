"""Queries on a workbook of two sheets made of the suppliers: parameters by section, and a table of flows that formulas derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import formula
from gridlake.operators import build as B
from gridlake.operators import evaluate as E
from gridlake.operators import items as I
from gridlake.operators import resolve as R
from gridlake.plans.model_catalog import formulas
from gridlake.plans.registry import load, query

PARAMETERS, FLOWS = "参数输入", "现金表"


def book(suppliers: DataFrame) -> DataFrame:
    """Parameters: a section before each tenth supplier; name in D, balance in I, unit in J. Flows: name in C, twice the balance in D,
    one and two more in E and F, headed by years; a formula in G that cannot be read for each tenth supplier."""
    k = F.col("s_suppkey").cast("int")
    upper, lower = k * 2 + 3, k + 3
    r = lower.cast("string")

    def cell(sheet: str, row: Column, col: int, num: Column | None = None, text: Column | None = None, raw: Column | None = None) -> Column:
        none = F.lit(None)
        given = [(num, "double", "v_num"), (text, "string", "v_str"), (raw, "string", "formula_raw")]
        return F.struct(F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), F.lit(col).alias("col_ix"), *[(none if x is None else x).cast(t).alias(n) for x, t, n in given])

    always = [
        cell(PARAMETERS, upper, 4, text=F.col("s_name")), cell(PARAMETERS, upper, 9, num=F.col("s_acctbal")), cell(PARAMETERS, upper, 10, text=F.lit("EUR")),
        cell(FLOWS, lower, 3, text=F.concat(F.lit("Flow of "), "s_name")), cell(FLOWS, lower, 4, raw=F.concat(F.lit(f"='{PARAMETERS}'!I"), upper.cast("string"), F.lit("*2"))),
        cell(FLOWS, lower, 5, raw=F.concat(F.lit("=D"), r, F.lit("+1"))), cell(FLOWS, lower, 6, raw=F.concat(F.lit("=E"), r, F.lit("+1"))),
    ]
    tenth = [cell(PARAMETERS, upper - 1, 2, text=F.concat(F.lit("Section "), (k / 10).cast("int").cast("string"))), cell(FLOWS, lower, 7, raw=F.concat(F.lit("=D"), r, F.lit("+(")))]
    rows = suppliers.select(F.explode(F.array(*always)).alias("x")).unionByName(suppliers.where(k % 10 == 0).select(F.explode(F.array(*tenth)).alias("x")))
    heads = [(PARAMETERS, 1, 4, None, "参数", None), (FLOWS, 1, 5, None, "2025年", None), (FLOWS, 1, 6, None, "2026年", None)]
    kind = "sheet string, row int, col_ix int, v_num double, v_str string, formula_raw string"
    return E.with_ids(rows.select("x.*").unionByName(suppliers.sparkSession.createDataFrame(heads, kind)))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")


def stored(cells: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """The cells with their values; `read` as for `evaluate.evaluate`."""
    values = E.evaluate(cells, read=read)
    return E.graph.checkpoint(cells.drop("v_num", "v_str").join(values, "id").select("id", *E.KEY, "v_num", "v_str", "formula_raw"))


SUPPLIERS = "s AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS a FROM supplier)"


@query(f"""
WITH {SUPPLIERS}, c AS (SELECT count(*) AS n, count(*) FILTER (k % 10 = 0) AS tenth FROM s)
SELECT unnest(['DEPENDS_ON', 'BELONGS_TO', 'PART_OF_SECTION', 'TIME_SERIES_OF']) AS relation, unnest([3 * n + tenth, 4 * n, n, 2 * n + tenth])::bigint AS n FROM c
""")
def book_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of each kind the whole graph has; formulas that cannot be read count by what they name."""
    return B.build(book(suppliers(spark, sf_dir))).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SUPPLIERS} SELECT '{PARAMETERS}!' || (2 * k + 3) || unnest(['!4', '!9']) AS source, 'BI_{PARAMETERS}_' || (2 * k + 3) AS target, unnest(['name', 'value']) AS role FROM s
UNION ALL SELECT '{FLOWS}!' || (k + 3) || unnest(['!3', '!4']), 'BI_{FLOWS}_' || (k + 3), unnest(['name', 'value']) FROM s
""")
def book_belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.item_edges(I.items(book(suppliers(spark, sf_dir))))
    return edges.where("relation = 'BELONGS_TO'").select("source", "target", "role")


@query(f"""
WITH {SUPPLIERS} SELECT 'BI_{PARAMETERS}_' || (2 * k + 3) AS item_id, name, 'EUR' AS unit, 'Section ' || (k // 10) AS section, round(a, 6) AS value FROM s
UNION ALL SELECT 'BI_{FLOWS}_' || (k + 3), 'Flow of ' || name, NULL, NULL, round(2 * a, 6) FROM s
""")
def book_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the value of their value cell, after evaluation."""
    cells = book(suppliers(spark, sf_dir))
    return I.valued(I.items(cells), E.evaluate(cells)).select("item_id", "name", "unit", "section", F.round("value", 6).alias("value"))


@query(f"""
WITH {SUPPLIERS}, f AS (SELECT k, a, a + abs(a) * 10 / 100 AS b FROM s WHERE name = (SELECT min(name) FROM s))
SELECT '{FLOWS}!' || (k + 3) || '!' || (4 + i) AS id, round(2 * a + i, 6) AS old, round(2 * b + i, 6) AS new FROM f, unnest([0, 1, 2]) AS t(i) WHERE a <> 0
""")
def question_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes if the first supplier's balance rises by a tenth, asked in words."""
    made_of = suppliers(spark, sf_dir)
    first = made_of.agg(F.min("s_name")).first()[0]
    plain = E.graph.checkpoint(book(made_of))
    read = E.formulas_read(plain)
    cells = stored(plain, read)
    changes = R.what_if(f"如果{first}增加10%，现金会怎样", I.items(cells), cells, read)
    return changes.select("id", F.round("old_num", 6).alias("old"), F.round("new_num", 6).alias("new"))


@query(f"""
WITH {SUPPLIERS}, v AS (SELECT k, unnest([{{'col': 5, 'v': 2 * a + 1}}, {{'col': 6, 'v': 2 * a + 2}}]) AS x FROM s)
SELECT k AS id, CASE WHEN k % 2 = 0 THEN 2026 ELSE 2030 END::int AS year, x.col AS col_ix, round(x.v, 6) AS value FROM v WHERE k % 2 = 1 OR x.col = 6
""")
def question_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's flow in a year that a heading has, or in one that none has."""
    made_of = suppliers(spark, sf_dir)
    year = F.when(F.col("s_suppkey") % 2 == 0, "2026").otherwise("2030")
    asked = made_of.select(F.col("s_suppkey").alias("id"), F.concat(year, F.lit("年Flow of "), "s_name", F.lit("是多少？")).alias("question"))
    cells = stored(book(made_of))
    return R.series_answers(asked, I.items(cells), cells).select("id", "year", "col_ix", F.round("value", 6).alias("value"))


@query(f"""
WITH {SUPPLIERS}, c AS (SELECT 3 + 7 * count(*) + 2 * count(*) FILTER (k % 10 = 0) AS n, 3 * count(*) FILTER (k % 5 = 0) AS hit FROM s)
SELECT n::bigint AS n_cells, hit::bigint AS n_affected, (n - hit - hit // 3)::bigint AS n_unchanged FROM c
""")
def recalc_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells an edit of each fifth supplier's balance reaches, and how many it leaves alone."""
    cells = book(suppliers(spark, sf_dir))
    edits = cells.where((F.col("sheet") == PARAMETERS) & (F.col("col_ix") == 9) & ((F.col("row") - 3) % 10 == 0))
    return E.reach(cells, edits.select("id", "v_num", "v_str"))


@query(f"""
WITH {SUPPLIERS}, c AS (SELECT 7 + CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END AS cells, k % 11 = 0 AS gone, k % 7 = 0 AND k % 11 <> 0 AS moved FROM s),
n AS (SELECT 3 + sum(cells) AS cells, coalesce(sum(cells) FILTER (gone), 0) AS cells_gone, count(*) AS n, count(*) FILTER (gone) AS gone, count(*) FILTER (moved) AS moved FROM c)
SELECT 'cells' AS part, 0::bigint AS added, cells_gone::bigint AS removed, (4 * moved)::bigint AS modified, (cells - cells_gone - 4 * moved)::bigint AS unchanged FROM n
UNION ALL SELECT 'items', 0, 2 * gone, 2 * moved, 2 * (n - gone - moved) FROM n
""")
def book_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the workbook: each eleventh supplier is gone and each seventh has a hundred more."""
    made_of = suppliers(spark, sf_dir)
    later = made_of.where(F.col("s_suppkey") % 11 != 0)
    later = later.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 100).otherwise(F.col("s_acctbal")))
    books = [E.graph.checkpoint(book(made_of)), E.graph.checkpoint(book(later))]
    return B.compare(*(stored(b, read) for b, read in zip(books, E.formulas_read_of(*books), strict=True)))


@query("SELECT right(p_brand, 1) AS form, count(*)::bigint AS n, count(*)::bigint AS same FROM part GROUP BY 1")
def program_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs written as JSON and read again."""
    p = formula.parsed(formulas(spark, sf_dir))
    back = formula.program_of(formula.program_json(F.col("program")))
    return p.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if(back.eqNullSafe(F.col("program"))).alias("same"))
