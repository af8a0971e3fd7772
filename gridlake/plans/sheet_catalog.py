"""Queries on cells, versions, items and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.operators import diff as D
from gridlake.operators import items as I
from gridlake.operators import resolve as R
from gridlake.plans.registry import load, money, query


@query("""
SELECT 'orders' AS sheet, o_orderkey AS row, 'custkey' AS col, o_custkey::double AS value FROM orders
UNION ALL SELECT 'orders', o_orderkey, 'totalprice', o_totalprice FROM orders
UNION ALL SELECT 'part', p_partkey, 'size', p_size::double FROM part UNION ALL SELECT 'part', p_partkey, 'retailprice', p_retailprice FROM part
""")
def cells_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as cells: one row for each number."""

    def cells(table: str, key: str, cols: dict[str, str]) -> DataFrame:
        df = load(spark, sf_dir, table).select(F.col(key).alias("row"), *[F.col(c).cast("double").alias(n) for n, c in cols.items()])
        return df.unpivot("row", list(cols), "col", "value").select(F.lit(table).alias("sheet"), "row", "col", "value")

    return cells("orders", "o_orderkey", {"custkey": "o_custkey", "totalprice": "o_totalprice"}).unionByName(
        cells("part", "p_partkey", {"size": "p_size", "retailprice": "p_retailprice"})
    )


def letters(n: F.Column) -> F.Column:
    """Column letters of a 1-based index: digits 1 to 26, most significant first."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(at, _):
        digit = F.concat(F.char((at["n"] - 1) % 26 + 65), at["s"])
        return F.when(at["n"] > 0, F.struct(F.floor((at["n"] - 1) / 26).alias("n"), digit.alias("s"))).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda at: at["s"])


def column_index(s: F.Column) -> F.Column:
    return F.aggregate(F.filter(F.split(F.upper(s), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)


@query("""
WITH RECURSIVE r AS (SELECT o_orderkey AS k, o_orderkey AS n, '' AS s FROM orders UNION ALL SELECT k, (n - 1) // 26, chr((65 + (n - 1) % 26)::int) || s FROM r WHERE n > 0)
SELECT k AS index, s AS letters, k AS back FROM r WHERE n = 0
""")
def col_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(k.alias("index"), letters(k).alias("letters")).select("index", "letters", column_index(F.col("letters")).alias("back"))


@query("""
WITH c AS (SELECT 'customer' AS sheet, unnest([
    {'col': 'name', 'num': try_cast(c_name AS double), 'str': c_name}, {'col': 'segment', 'num': try_cast(c_mktsegment AS double), 'str': c_mktsegment},
    {'col': 'balance', 'num': c_acctbal, 'str': NULL}, {'col': 'nation', 'num': c_nationkey::double, 'str': NULL}]) AS x FROM customer)
SELECT sheet, x.col AS col, count(*)::bigint AS cells, count(x.num)::bigint AS numbers, (count(x.str) FILTER (x.num IS NULL))::bigint AS texts, count(DISTINCT coalesce(x.str, x.num::varchar))::bigint AS distinct_values
FROM c GROUP BY 1, 2
""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None)
    text = lambda name, c: F.struct(F.lit(name).alias("col"), F.col(c).try_cast("double").alias("num"), F.col(c).alias("str"))
    number = lambda name, c: F.struct(F.lit(name).alias("col"), F.col(c).cast("double").alias("num"), null.cast("string").alias("str"))
    cells = load(spark, sf_dir, "customer").select(
        F.explode(F.array(text("name", "c_name"), text("segment", "c_mktsegment"), number("balance", "c_acctbal"), number("nation", "c_nationkey"))).alias("x")
    )
    return cells.groupBy(F.lit("customer").alias("sheet"), F.col("x.col").alias("col")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("x.num").alias("numbers"), F.count_if(F.col("x.num").isNull() & F.col("x.str").isNotNull()).alias("texts"),
        F.countDistinct(F.coalesce("x.str", F.col("x.num").cast("string"))).alias("distinct_values"),
    )


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they are, and as they would be after a revision: finished urgent ones go,
    large ones come again, pending ones change their price."""
    old = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("sheet"), money("o_totalprice").alias("value"), F.col("o_orderpriority").alias("formula"))
    revised = F.when(F.col("sheet") == "P", F.col("value") + 1).otherwise(F.col("value")).cast("decimal(18,2)")
    kept = old.where("formula <> '1-URGENT' OR sheet <> 'F'").withColumn("value", revised)
    new = old.where("value > 300000").withColumn("id", -F.col("id"))
    return old, kept.unionByName(new)


VERSIONS = """a AS (SELECT o_orderkey AS id, o_orderstatus AS sheet, o_totalprice::decimal(18,2) AS value, o_orderpriority AS p FROM orders),
b AS (SELECT id, sheet, (value + CASE WHEN sheet = 'P' THEN 1 ELSE 0 END)::decimal(18,2) AS value FROM a WHERE p <> '1-URGENT' OR sheet <> 'F' UNION ALL SELECT -id, sheet, value FROM a WHERE value > 300000),
d AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.sheet, b.sheet) AS sheet, a.value::double AS old_value, b.value::double AS new_value,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.value = b.value THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.id = b.id)"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    d = D.diff(old, new, ["id"], ["sheet", "value", "formula"])
    return d.select("id", F.coalesce("old_sheet", "new_sheet").alias("sheet"), F.col("old_value").cast("double").alias("old_value"), F.col("new_value").cast("double").alias("new_value"), "status")


@query(f"WITH {VERSIONS} SELECT id, sheet, old_value, new_value, status FROM d")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir)


@query(f"""
WITH {VERSIONS}, c AS (SELECT count(*) FILTER (status = 'added')::bigint AS added, count(*) FILTER (status = 'removed')::bigint AS removed,
  count(*) FILTER (status = 'modified')::bigint AS modified, count(*) FILTER (status = 'unchanged')::bigint AS unchanged FROM d)
SELECT *, added + removed + modified AS total_changes, 'v1 vs v2: +' || added || ' / -' || removed || ' / ~' || modified || ' (' || unchanged || ' unchanged)' AS summary FROM c
""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(_diffs(spark, sf_dir), "v1", "v2")


@query(f"WITH {VERSIONS} SELECT sheet, count(*) FILTER (status = 'added')::bigint AS added, count(*) FILTER (status = 'removed')::bigint AS removed, count(*) FILTER (status = 'modified')::bigint AS modified, count(*) FILTER (status = 'unchanged')::bigint AS unchanged FROM d GROUP BY 1")
def diff_by_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counts(_diffs(spark, sf_dir), "sheet")


@query(f"WITH {VERSIONS} SELECT id, status, old_value, new_value FROM d WHERE status <> 'unchanged' ORDER BY status, id LIMIT 20")
def first_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).where("status <> 'unchanged'").orderBy("status", "id").limit(20).select("id", "status", "old_value", "new_value")


@query("""
WITH a AS (SELECT p_name AS name, arg_max(p_retailprice, p_partkey) AS v FROM part GROUP BY 1),
b AS (SELECT p_name AS name, arg_max(p_retailprice, p_partkey) AS v FROM part WHERE p_size <= 40 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, a.v AS old_v, b.v AS new_v, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS status
FROM a FULL JOIN b ON a.name = b.name
""")
def item_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are compared by name; of several with one name the last one counts."""
    part = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), "p_size")
    last = lambda df: df.groupBy("name").agg(F.max_by("v", "k").alias("v"))
    return D.diff(last(part), last(part.where("p_size <= 40")), ["name"], ["v"])


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return rows.orderBy("orderkey").offset(20).limit(20)


@query("SELECT p_partkey AS partkey, p_name AS name FROM part WHERE contains(lower(p_name), 'al')")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.lower("p_name").contains("al")).select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"))


@query("""
SELECT orderkey, line, partkey, rank FROM (SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS partkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::int AS rank FROM lineitem) WHERE rank <= 5
""")
def first_k_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    ranked = load(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return ranked.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"), "rank")


@query("""
WITH r AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part), n AS (SELECT brand, name, row_number() OVER (PARTITION BY brand ORDER BY name) AS k FROM r)
SELECT brand, count(*)::bigint AS n, string_agg(name, ', ' ORDER BY name) FILTER (k <= 5) AS first_names FROM n GROUP BY 1
""")
def group_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).distinct()
    ranked = names.withColumn("k", F.row_number().over(Window.partitionBy("brand").orderBy("name")))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("name"))))
    return ranked.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.array_join(first, ", ").alias("first_names"))


@query("SELECT md5(text) AS file_hash, min(doc_id) AS id, count(*)::bigint AS uploads FROM documents GROUP BY 1")
def registry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads are registered once by their hash, under the first id."""
    docs = load(spark, sf_dir, "documents").select(F.md5("text").alias("file_hash"), "doc_id")
    return docs.groupBy("file_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("uploads"))


@query("SELECT event_id AS id, event_type AS status, user_id AS owner FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("user_id").alias("owner"))


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 30")
def inputs_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input cells by size, a page of them."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return rows.orderBy(F.desc(F.abs("value")), "id").limit(30)


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')) AS w FROM documents)
SELECT doc_id, count(*)::bigint AS names, count(*) FILTER (length(w) < 3)::bigint AS short, count(*) FILTER (regexp_matches(w, '^[A-Z]{1,3}$'))::bigint AS letters,
  count(*) FILTER (regexp_matches(w, '^[+-]?[0-9,]+\\.?[0-9]*$'))::bigint AS numbers FROM w WHERE w <> '' GROUP BY 1
""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a text's words are no item names, by reason. Counted inside each row, without a shuffle."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = load(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    count = lambda test: F.size(F.filter("w", test)).cast("long")
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("names"), count(lambda w: F.length(w) < I.SHORTEST).alias("short"),
        count(lambda w: w.rlike(I.NOISE[2])).alias("letters"), count(lambda w: w.rlike(I.NOISE[3])).alias("numbers"),
    )


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations
""")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below a marker belong to it: the last user turn is carried on."""
    rows = load(spark, sf_dir, "conversations")
    marker = F.when(F.col("role") == "user", F.col("turn"))
    return rows.select("conv_id", "turn", "role", I.carried(rows, marker, "turn", "conv_id").alias("section"))


@query("""
WITH m AS (SELECT p_brand AS brand, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT brand, min(m)::int AS ts_start, max(m)::int AS ts_end, count(*)::bigint AS points, sum(q)::double AS total FROM m GROUP BY 1
""")
def ts_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m")
    # Quantities are summed by part first, so the join moves one row for each part and month.
    by_part = lines.groupBy("l_partkey", month).agg(F.sum("l_quantity").alias("q"))
    m = by_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand"), "m").agg(F.sum("q").alias("q"))
    return m.groupBy("brand").agg(F.min("m").alias("ts_start"), F.max("m").alias("ts_end"), F.count(F.lit(1)).alias("points"), F.sum("q").alias("total"))


@query("""
WITH b AS (SELECT p_brand AS brand, sum(p_retailprice::decimal(18,2))::double AS v FROM part GROUP BY 1)
SELECT x.brand AS a, y.brand AS b, round(x.v - y.v, 2) AS difference, CASE WHEN y.v <> 0 THEN round((x.v - y.v) / abs(y.v) * 100, 6) ELSE 0 END AS percent
FROM b x, b y WHERE x.brand = (SELECT min(brand) FROM b) AND y.brand = (SELECT max(brand) FROM b)
""")
def entity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities side by side: one conditional aggregate instead of two lookups."""
    b = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.sum(money("p_retailprice")).cast("double").alias("v"))
    both = b.agg(F.min("brand").alias("a"), F.min_by("v", "brand").alias("x"), F.max("brand").alias("b"), F.max_by("v", "brand").alias("y"))
    d = F.col("x") - F.col("y")
    return both.select("a", "b", F.round(d, 2).alias("difference"), F.when(F.col("y") != 0, F.round(d / F.abs("y") * 100, 6)).otherwise(0.0).alias("percent"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each part, in four forms."""
    name, year = F.col("p_name"), (F.lit(2000) + F.col("p_size") % 25).cast("string")
    text = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(year, F.lit("年"), name, F.lit("是多少？")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("如果"), name, F.lit("增加"), F.col("p_size"), F.when(F.col("p_partkey") % 8 == 1, "%").otherwise(""), F.lit("，会怎样")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(name, F.lit("和"), F.col("p_brand"), F.lit("对比")))
        .otherwise(name)
    )
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("question"), F.col("p_retailprice").alias("price"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'what_if' WHEN 2 THEN 'compare' ELSE 'other' END AS kind, p_name AS entity,
  CASE WHEN p_partkey % 4 = 2 THEN p_brand END AS other, CASE WHEN p_partkey % 4 = 0 THEN 2000 + p_size % 25 END::int AS year,
  CASE WHEN p_partkey % 8 = 1 THEN round(p_retailprice + p_retailprice * p_size / 100, 6) WHEN p_partkey % 4 = 1 THEN round(p_retailprice + p_size, 6) END AS changed FROM part
""")
def intent_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _questions(spark, sf_dir).select("id", "price", R.intent(F.col("question")).alias("i"))
    new = F.when(F.col("i.kind") == "what_if", F.round(R.changed(F.col("price"), F.col("i.action"), F.col("i.amount"), F.col("i.percent")), 6))
    return rows.select("id", "i.kind", "i.entity", "i.other", "i.year", new.alias("changed"))


@query("""
WITH v AS (SELECT p_name AS name, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY 1),
q AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'what_if' WHEN 2 THEN 'compare' ELSE 'other' END AS kind FROM part)
SELECT id, kind, name, value FROM q JOIN v USING (name)
""")
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that each question asks for."""
    values = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("value"))
    return R.answers(_questions(spark, sf_dir), values).select("id", "kind", "name", "value")


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their first letters missing, matched to part names."""
    part = load(spark, sf_dir, "part")
    asked = part.select(F.expr("substring(p_name, 3)").alias("entity")).distinct()
    return R.fuzzy(asked, part.select(F.col("p_name").alias("name")))


@query("""
WITH w AS (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS keyword FROM part)
SELECT keyword, min(k) AS first_item, max(k) AS last_item, count(*)::bigint AS n FROM w WHERE length(keyword) > 1 GROUP BY 1
""")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of names: the first item wins, full names would take the last."""
    words = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(R.keywords(F.col("p_name"))).alias("keyword"))
    return words.groupBy("keyword").agg(F.min("k").alias("first_item"), F.max("k").alias("last_item"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus AS sheet, count(*)::bigint AS cells, count(DISTINCT o_custkey)::bigint AS sources, count(*) FILTER (o_totalprice > 100000)::bigint AS large,
  sum(o_totalprice::decimal(18,2))::double AS total FROM orders GROUP BY 1
""")
def sheet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("sheet")).agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("o_custkey").alias("sources"), F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.sum(money("o_totalprice")).cast("double").alias("total"),
    )


@query("""
SELECT count(*)::bigint AS nodes, count(DISTINCT o_custkey)::bigint AS sources, sum(o_totalprice::decimal(18,2))::double AS total, count(*) FILTER (o_orderstatus = 'O')::bigint AS open FROM orders
""")
def graph_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes to JSON text and back with a given schema; counts and sums must survive."""
    rows = load(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")).alias("j"))
    back = rows.select(F.from_json("j", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").alias("r")).select("r.*")
    return back.agg(
        F.count("o_orderkey").alias("nodes"), F.countDistinct("o_custkey").alias("sources"), F.sum(money("o_totalprice")).cast("double").alias("total"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
    )
