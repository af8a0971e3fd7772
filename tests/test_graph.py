"""Graph operators against plain loops over small graphs, and chains far longer than the rounds they take."""

import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import graph, ranges


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, tgt long")


def plain_reached(pairs, start):
    seen, todo = set(start), list(start)
    while todo:
        at = todo.pop()
        for s, t in pairs:
            if t == at and s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def plain_levels(pairs):
    nodes = {x for p in pairs for x in p}
    found = {}
    while True:
        ready = [n for n in nodes - set(found) if all(t in found for s, t in pairs if s == n)]
        if not ready:
            return {n: found.get(n) for n in nodes}
        found |= {n: max((found[t] + 1 for s, t in pairs if s == n), default=0) for n in ready}


def plain_components(pairs):
    nodes = {x for p in pairs for x in p}
    down = {n: plain_reached([(t, s) for s, t in pairs], [n]) for n in nodes}
    same = {n: {m for m in down[n] if n in down[m]} for n in nodes}
    return {n: min(m) for n, m in same.items() if len(m) > 1}


def graphs():
    rng = random.Random(5)
    chain = [(k, k - 1) for k in range(1, 40)]
    inputs = [(k, 1000 + k) for k in range(40)]
    ring = [(200 + k, 200 + (k + 1) % 30) for k in range(30)]
    hung = [(300 + k, 299 + k) for k in range(1, 25)] + [(300, 205)] + [(207, 400)] + [(400 + k, 401 + k) for k in range(20)]
    loop = [(500, 501)] + [(501 + k, 502 + k) for k in range(12)] + [(513, 500), (500, 520), (520, 500), (506, 600)]
    yield chain + inputs
    yield ring + hung + loop
    for n, m in ((30, 32), (40, 50)):
        yield [p for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]]


@pytest.mark.parametrize("pairs", list(graphs()), ids=range(4))
def test_contracted_graphs_equal_plain_loops(spark, monkeypatch, pairs):
    monkeypatch.setattr(graph, "CHAINED", 1)
    monkeypatch.setattr(graph, "LOOKED", 1)
    edges = table(spark, pairs)
    assert {r.id: r.level for r in graph.levels(edges).collect()} == plain_levels(pairs)
    assert {r.id: r.scc for r in graph.components(edges).collect()} == plain_components(pairs)
    start = spark.createDataFrame([(pairs[0][1],)], "id long")
    assert sorted(r.id for r in graph.reached(edges, start).collect()) == sorted(plain_reached(pairs, [pairs[0][1]]))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 20_000
    k = spark.range(1, n)
    chain = k.selectExpr("id AS src", "id - 1 AS tgt").unionByName(k.selectExpr("id AS src", "id + 1000000 AS tgt"))
    written = []
    cut = graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: written.append(1) or cut(df))
    top = graph.levels(chain).agg({"level": "max"}).first()[0]
    assert top == n - 1
    assert graph.reached(chain, spark.createDataFrame([(0,)], "id long")).count() == n
    ring = k.selectExpr("id AS src", f"id % {n - 1} + 1 AS tgt")
    found = graph.components(ring.unionByName(spark.createDataFrame([(1, 50_000), (50_000, 50_001)], "src long, tgt long")))
    assert found.agg({"scc": "max"}).first()[0] == 1 and found.count() == n - 1
    assert len(written) < 150


def test_written_tables_of_many_keys_are_not_sent_through_the_driver(spark):
    """300 000 consecutive keys take a small file, but not a small table."""
    many = graph.checkpoint(spark.range(300_000, numPartitions=1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("tgt")))
    few = graph.checkpoint(spark.range(10).select(F.col("id").alias("src")))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.join(many.select(F.col("tgt").alias("src"), F.lit(1).alias("x")), "src"))
    assert "BroadcastHashJoin" in plan(many.join(few, "src"))


def test_shuffled_tables_of_many_keys_are_not_broadcast_either(spark):
    """A shuffle of 300 000 keys takes under 10 MB, from which Spark would make a broadcast of 20."""
    many = graph.checkpoint(spark.range(300_000).select(F.xxhash64("id").alias("src"), F.xxhash64("id", F.lit(1)).alias("tgt")))
    joined = many.join(many.groupBy(F.col("tgt").alias("src")).agg(F.count(F.lit(1)).alias("n")), "src", "left")
    assert joined.collect()[0]["n"] is None
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_long_ranges_are_covered_whole(spark):
    """Tables that stand for a sheet may have more rows than one."""
    rects = spark.createDataFrame([("s", 1, 1, n, 1) for n in (5, 2**21, 5_400_000, 10**9)], "sheet string, row int, col int, end_row int, end_col int")
    held = ranges.tiles_of(rects).groupBy("end_row").agg(F.sum(F.expr("shiftleft(1L, row_power)")).alias("n")).collect()
    assert {r["end_row"]: r["n"] for r in held} == {n: n for n in (5, 2**21, 5_400_000, 10**9)}
