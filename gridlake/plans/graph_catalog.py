"""Queries on dependency graphs: the tables as a hierarchy of cells, and a graph of blocks over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import graph
from gridlake.plans.registry import load, money, query


def node(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt, relation: totals roll up, so a region depends on its nations, these on customers, these on orders."""
    nation, customer, orders = (load(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    parts = [
        nation.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("tgt"), F.lit("region_nation").alias("relation")),
        customer.select(node("nation", "c_nationkey").alias("src"), node("customer", "c_custkey").alias("tgt"), F.lit("nation_customer").alias("relation")),
        orders.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("tgt"), F.lit("customer_order").alias("relation")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HIERARCHY = """hierarchy AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS tgt, 'region_nation' AS relation FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'nation_customer' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'customer_order' FROM orders)"""


@query(f"WITH {HIERARCHY} SELECT DISTINCT src, tgt, relation FROM hierarchy")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(spark, sf_dir).dropDuplicates(["src", "tgt"])


@query(f"WITH {HIERARCHY} SELECT relation, count(*)::bigint AS edges, count(DISTINCT src)::bigint AS dependents, count(DISTINCT tgt)::bigint AS precedents FROM hierarchy GROUP BY 1")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(spark, sf_dir).groupBy("relation").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("dependents"), F.countDistinct("tgt").alias("precedents")
    )


@query("""
SELECT 'order_without_lines' AS kind, count(*)::bigint AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'line_without_order', count(*)::bigint FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'label_without_document', count(*)::bigint FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'document_without_label', count(*)::bigint FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)
""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, labels, docs = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "labels", "documents"))
    keys = lines.select(F.col("l_orderkey").alias("o_orderkey"))

    def count(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    return (
        count(orders.join(keys, "o_orderkey", "left_anti"), "order_without_lines")
        .unionByName(count(keys.join(orders, "o_orderkey", "left_anti"), "line_without_order"))
        .unionByName(count(labels.join(docs, "doc_id", "left_anti"), "label_without_document"))
        .unionByName(count(docs.select("doc_id").join(labels, "doc_id", "left_anti"), "document_without_label"))
    )


@query("""
SELECT a.o_orderkey AS src, count(*)::bigint AS n_cells, sum(b.o_totalprice::decimal(18,2))::double AS total
FROM orders a JOIN orders b ON b.o_orderkey BETWEEN a.o_orderkey AND a.o_orderkey + 4 GROUP BY 1
""")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's range of five rows, expanded to the cells that exist: the range becomes keys, so an equi-join finds them."""
    orders = load(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_orderkey").alias("src"), F.explode(F.sequence(F.col("o_orderkey"), F.col("o_orderkey") + 4)).alias("row"))
    cells = orders.select(F.col("o_orderkey").alias("row"), money("o_totalprice").alias("v"))
    return refs.join(cells, "row").groupBy("src").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("v").cast("double").alias("total"))


@query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS tgt FROM lineitem
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer),
r AS (SELECT 'supplier:' || min(s_suppkey) AS id, 0 AS depth FROM supplier
      UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.tgt = r.id WHERE r.depth < 3)
SELECT id, min(depth)::int AS depth FROM r GROUP BY 1
""")
def dependents_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the first supplier, in at most three steps."""
    lines, orders, customer, supplier = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    edges = (
        lines.select(node("order", "l_orderkey").alias("src"), node("supplier", "l_suppkey").alias("tgt")).distinct()
        .unionByName(orders.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("tgt")))
        .unionByName(customer.select(node("nation", "c_nationkey").alias("src"), node("customer", "c_custkey").alias("tgt")))
    )
    start = supplier.agg(F.min("s_suppkey").alias("k")).select(node("supplier", "k").alias("id"))
    return graph.downstream(edges, start, 3)


@query(f"""
WITH RECURSIVE {HIERARCHY},
r AS (SELECT DISTINCT tgt AS id, 0 AS level FROM hierarchy WHERE tgt NOT IN (SELECT src FROM hierarchy)
      UNION SELECT h.src, r.level + 1 FROM r JOIN hierarchy h ON h.tgt = r.id)
SELECT id, max(level)::int AS level FROM r GROUP BY 1
""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(hierarchy(spark, sf_dir))


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """src, tgt of the customers' orders, which are numbered below zero, and the customers' keys."""
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return orders.select(F.col("o_custkey").cast("long").alias("src"), (-1 - F.col("o_orderkey")).cast("long").alias("tgt")), customer


@query("""
WITH c AS (SELECT c_custkey AS k, min(c_custkey) OVER () AS k0 FROM customer), j AS (SELECT min(o_custkey) AS j0 FROM orders)
SELECT k AS id, greatest(k - k0, CASE WHEN k >= j0 THEN k - j0 + 1 ELSE 0 END)::int AS level FROM c, j UNION ALL SELECT -1 - o_orderkey, 0 FROM orders
""")
def chain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer depends on the one before it and on its own orders: a chain as long as the table, with inputs on the way."""
    orders, customer = accounts(spark, sf_dir)
    chain = customer.join(customer.select((F.col("k") + 1).alias("k")), "k", "left_semi").select(F.col("k").alias("src"), (F.col("k") - 1).alias("tgt"))
    return graph.levels(chain.unionByName(orders))


@query("SELECT c_custkey AS id, c_custkey % 25 AS scc FROM customer")
def ring_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th customer is on one ring, so rings grow with the table; orders hang on them."""
    orders, customer = accounts(spark, sf_dir)
    n = customer.agg(F.max("k")).first()[0] or 0
    k = F.col("k")
    ring = customer.select(k.alias("src"), F.when(k + 25 <= n, k + 25).otherwise(k % 25).alias("tgt"))
    return graph.components(ring.unionByName(orders))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over the parts, in blocks of five keys: even blocks are cycles, odd ones chains, some are bridged."""
    part = load(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("k"))
    n = F.col("n")
    part = part.crossJoin(F.broadcast(part.agg((F.max("k") + 1).alias("n"))))  # one row
    b, i = F.floor(F.col("k") / 5), F.col("k") % 5
    cycle = F.when((b % 2 == 0), b * 5 + (i + 1) % 5)
    chain = F.when((b % 2 == 1) & (i < 4), F.col("k") + 1)
    bridge = F.when((i == 0) & (b % 4 < 3), F.col("k") + 5)
    out = part.select(F.col("k").alias("src"), "n", F.explode(F.array(cycle, chain, bridge)).alias("tgt"))
    return out.where(F.col("tgt").isNotNull() & (F.col("tgt") < n)).select("src", F.col("tgt").cast("long").alias("tgt"))


BLOCKS = """n AS (SELECT max(p_partkey) AS n FROM part), k AS (SELECT p_partkey - 1 AS k, (p_partkey - 1) // 5 AS b, (p_partkey - 1) % 5 AS i FROM part),
blocks AS (SELECT src, tgt FROM (
  SELECT k AS src, b * 5 + (i + 1) % 5 AS tgt FROM k WHERE b % 2 = 0
  UNION ALL SELECT k, k + 1 FROM k WHERE b % 2 = 1 AND i < 4
  UNION ALL SELECT k, k + 5 FROM k WHERE i = 0 AND b % 4 < 3), n WHERE tgt < n)"""


@query(f"""
WITH RECURSIVE {BLOCKS}, r AS (SELECT src, tgt FROM blocks UNION SELECT r.src, b.tgt FROM r JOIN blocks b ON b.src = r.tgt)
SELECT a.src AS id, min(a.tgt) AS scc FROM r a JOIN r b ON a.src = b.tgt AND a.tgt = b.src GROUP BY a.src HAVING count(*) > 1
""")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(blocks(spark, sf_dir))


@query(f"""
WITH RECURSIVE {BLOCKS}, p AS (SELECT src AS first, tgt AS last, [src, tgt] AS path FROM blocks WHERE tgt > src
  UNION ALL SELECT p.first, b.tgt, list_append(p.path, b.tgt) FROM p JOIN blocks b ON b.src = p.last WHERE b.tgt > p.first AND NOT list_contains(p.path, b.tgt) AND len(p.path) < 8)
SELECT array_to_string(list_sort(path), ',') AS members, len(path)::int AS length FROM p JOIN blocks b ON b.src = p.last AND b.tgt = p.first
""")
def short_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.short_cycles(blocks(spark, sf_dir))
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("members"), "length")


@query(f"""
WITH {HIERARCHY}, s AS (SELECT DISTINCT src AS id FROM hierarchy WHERE relation = 'nation_customer' ORDER BY 1 LIMIT 80),
o AS (SELECT DISTINCT id FROM (SELECT tgt AS id FROM hierarchy WHERE src IN (FROM s) UNION SELECT src FROM hierarchy WHERE tgt IN (FROM s)) WHERE id NOT IN (FROM s) ORDER BY 1 LIMIT 70),
n AS (SELECT id FROM s UNION SELECT id FROM o)
SELECT DISTINCT src, tgt FROM hierarchy WHERE src IN (FROM n) AND tgt IN (FROM n) ORDER BY 1, 2 LIMIT 500
""")
def subgraph_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn around the nations."""
    edges = hierarchy(spark, sf_dir)
    return graph.neighbourhood(edges, edges.where("relation = 'nation_customer'").select(F.col("src").alias("id")))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 1),
l AS (SELECT l_orderkey, l_extendedprice::decimal(18,2) AS old,
  CASE WHEN (l_orderkey, l_linenumber, l_partkey, l_suppkey) = (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM e) THEN round(l_extendedprice * 1.1, 2) ELSE l_extendedprice END::decimal(18,2) AS new FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, sum(old) AS old, sum(new) AS new FROM l JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT c_custkey, c_nationkey, sum(old) AS old, sum(new) AS new FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT n_nationkey, n_regionkey, sum(old) AS old, sum(new) AS new FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT n_regionkey, sum(old) AS old, sum(new) AS new FROM n GROUP BY 1)
SELECT level, node_id, old::double AS old_value, new::double AS new_value, (new - old)::double AS delta FROM (
  SELECT 'order' AS level, o_orderkey AS node_id, old, new FROM o UNION ALL SELECT 'customer', c_custkey, old, new FROM c
  UNION ALL SELECT 'nation', n_nationkey, old, new FROM n UNION ALL SELECT 'region', n_regionkey, old, new FROM r) WHERE old <> new
""")
def recalc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's price rises by a tenth: which totals change, and by how much. Levels are known, so they are joins and sums;
    only what the edit touches is summed, for the others keep their value."""
    lines, orders, customer, nation = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edit = lines.agg(F.min(key).alias("edit"))
    old = money("l_extendedprice")
    new = F.when(key == F.col("edit"), money(F.round(F.col("l_extendedprice") * 1.1, 2))).otherwise(old)
    dirty = orders.join(edit, F.col("o_orderkey") == F.col("edit.l_orderkey")).select("o_custkey", "edit")
    place = dirty.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("edit", F.col("o_custkey").alias("d_cust"), F.col("c_nationkey").alias("d_nation"), F.col("n_regionkey").alias("d_region"))
    # Nothing outside the edit's region changes, so its few rows are found first and orders and lines are filtered by them.
    nations = nation.join(F.broadcast(place), F.col("n_regionkey") == F.col("d_region")).drop("n_name")
    customers = customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    every = (
        lines.join(orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "o_custkey", "c_nationkey", "n_regionkey", "edit", "d_cust", "d_nation", old.alias("old"), new.alias("new"))
    )
    levels = F.explode(
        F.filter(
            F.array(
                F.struct(F.lit("order").alias("level"), F.col("l_orderkey").alias("node_id"), (F.col("l_orderkey") == F.col("edit.l_orderkey")).alias("hit")),
                F.struct(F.lit("customer").alias("level"), F.col("o_custkey").alias("node_id"), (F.col("o_custkey") == F.col("d_cust")).alias("hit")),
                F.struct(F.lit("nation").alias("level"), F.col("c_nationkey").cast("long").alias("node_id"), (F.col("c_nationkey") == F.col("d_nation")).alias("hit")),
                F.struct(F.lit("region").alias("level"), F.col("n_regionkey").cast("long").alias("node_id"), F.lit(True).alias("hit")),
            ),
            lambda x: x["hit"],
        )
    ).alias("at")
    sums = every.select(levels, "old", "new").groupBy("at.level", "at.node_id").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    return sums.where("old <> new").select(
        "level", "node_id", F.col("old").cast("double").alias("old_value"), F.col("new").cast("double").alias("new_value"), (F.col("new") - F.col("old")).cast("double").alias("delta")
    )


@query("""
WITH p AS (SELECT min(l_partkey) AS p FROM lineitem),
d AS (SELECT o_custkey AS custkey, sum(CASE WHEN l_partkey = p THEN round(l_extendedprice * 0.1, 2) ELSE 0 END::decimal(18,2)) AS delta, sum(l_extendedprice::decimal(18,2)) AS old
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey, p GROUP BY 1)
SELECT custkey, old::double AS old_value, delta::double AS delta, round(delta::double / abs(old::double) * 100, 6) AS percent FROM d WHERE delta <> 0 ORDER BY abs(delta) DESC, custkey LIMIT 5
""")
def impact_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customers whose total changes most when one part's price rises by a tenth."""
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    part = F.broadcast(lines.agg(F.min("l_partkey").alias("edit")))  # one row
    delta = F.when(F.col("l_partkey") == F.col("edit"), money(F.round(F.col("l_extendedprice") * 0.1, 2))).otherwise(F.lit(0).cast("decimal(18,2)"))
    per = lines.crossJoin(part).select("l_orderkey", money("l_extendedprice").alias("old"), delta.alias("delta")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per = per.groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum("old").alias("old"), F.sum("delta").alias("delta")).where("delta <> 0")
    top = per.orderBy(F.desc(F.abs("delta")), "custkey").limit(5)
    old, change = F.col("old").cast("double"), F.col("delta").cast("double")
    return top.select("custkey", old.alias("old_value"), change.alias("delta"), F.round(F.when(old != 0, change / F.abs(old) * 100).otherwise(0.0), 6).alias("percent"))
