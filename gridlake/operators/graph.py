"""Dependency graphs as edge tables: neighbours, reachability, levels, strongly connected components, cycles.

Edges run from a dependent node to its precedent: columns src, tgt. Loops run on the driver, one join a round;
each round is cut by a checkpoint, so plans stay short and a lost executor does not bring a round back. Rounds
follow the depth of the graph that is left when chains are contracted: where one node hangs to the next, again and again, pointers are doubled, so a chain
of any length takes the logarithm of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chains are contracted where so many of their nodes hang to another one; every so many rounds they are looked for.
CHAINED, LOOKED = 50, 4
#: How many times larger a written table of keys may be in memory than in its file; by the bare size of files, Spark would send tables of millions of rows
#: through the driver. What is small by this measure is broadcast at once, other tables where a shuffle has shown that they are.
UNPACKED = 30
#: Bytes of a shuffled table, packed as they are, up to which it may still be broadcast after its shuffle. Each round of a loop joins anew, so at Spark's own
#: 10 MB, which hold 30 MB of keys, the rounds together send more through the driver than it should see; a table that has been shuffled gains little by it.
BROADCAST = "512k"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a local one if Spark runs on one
    machine, otherwise it is an error, for executors would write where others cannot read."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def checkpoint(df: DataFrame, *by: str) -> DataFrame:
    """Cuts lineage: the table is written into the shared folder, once, in folders for the values of the columns `by`, and read from there, until the program ends."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)
    path = f"{shared_dir(spark)}/gridlake-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clean() -> None:
    """Deletes what `checkpoint` has written."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def precedents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("tgt").distinct()


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("tgt") == node).select("src").distinct()


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target exists, each once. `nodes` has column id."""
    return edges.dropDuplicates(["src", "tgt"]).join(nodes.select(F.col("id").alias("tgt")), "tgt", "left_semi")


def downstream(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """id, depth: everything that depends on the nodes `start` (column id), by the least number of steps."""
    seen = checkpoint(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        step = edges.join(frontier.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(F.col("src").alias("id")).distinct()
        frontier = checkpoint(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id: the nodes `start` (column id) and everything that depends on them, by any number of steps. Now and then each node that is not reached
    yet points to one of its precedents, pointers are doubled, and what comes to a reached node is reached."""
    edges = checkpoint(edges.select("src", "tgt").distinct())
    frontier = seen = checkpoint(start.select("id").distinct())
    rounds = 0
    while True:
        rounds += 1
        step = edges.join(frontier.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(F.col("src").alias("id")).distinct()
        frontier = checkpoint(step.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if rounds % (2 * LOOKED) == 0:
            far = _pointed(edges, seen)
            if far is not None:
                frontier, seen = frontier.unionByName(far), checkpoint(seen.unionByName(far))


def _pointed(edges: DataFrame, seen: DataFrame) -> DataFrame | None:
    """id: nodes not seen from which one path of precedents, of those that have precedents or are seen, leads to a seen node."""
    inner = edges.select(F.col("src").alias("tgt")).distinct().unionByName(seen.select(F.col("id").alias("tgt"))).distinct()
    unseen = edges.join(seen.select(F.col("id").alias("src")), "src", "left_anti").join(inner, "tgt", "left_semi")
    links = checkpoint(unseen.groupBy(F.col("src").alias("id")).agg(F.min("tgt").alias("prev")))
    if links.join(links.select(F.col("id").alias("prev")), "prev", "left_semi").count() < CHAINED:
        return None
    return checkpoint(_ends(links).join(seen.select(F.col("id").alias("end")), "end", "left_semi").select("id"))


def _ends(links: DataFrame) -> DataFrame:
    """id, end, least, open of a table id, prev with one row for each id: where the pointers lead that start at it, and the least node met before the end. Those
    that come to no end, being on rings or behind them, are open; for one on a ring `least` is the least of the ring."""
    paths = checkpoint(links.select("id", F.col("prev").alias("end"), F.col("id").alias("least"), F.lit(True).alias("open")))
    for _ in range(paths.count().bit_length() + 1):
        on = paths.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("least").alias("least2"))
        joined = paths.join(on, "end", "left")
        paths = checkpoint(joined.select("id", F.coalesce("end2", "end").alias("end"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("end2").isNotNull().alias("open")))
        if paths.where("open").isEmpty():
            break
    return paths


def levels(edges: DataFrame) -> DataFrame:
    """id, level: 0 for nodes without precedents, otherwise one more than the highest precedent. Nodes on cycles,
    and what depends on them, have none (null).

    A node with one open precedent left is at `floor` or at that one's level plus `w`, whichever is higher. Such maps compose, so chains are contracted."""
    open_ = checkpoint(edges.select("src", "tgt").distinct().withColumn("w", F.lit(1).cast("long")))
    nodes = open_.select(F.col("src").alias("id")).unionByName(open_.select(F.col("tgt").alias("id"))).distinct()
    rest, out, rounds = checkpoint(nodes.withColumn("floor", F.lit(0).cast("long"))), None, 0
    while True:
        rounds += 1
        ready = rest.join(open_.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        done = checkpoint(ready.select("id", F.col("floor").alias("level")))
        if done.isEmpty():
            break
        if rounds % LOOKED == 0:
            maps = _composed(rest, open_)
            if maps is not None:
                along = maps.join(done.select(F.col("id").alias("prev"), "level"), "prev").select("id", F.greatest(F.col("level") + F.col("w"), F.col("floor")).alias("level"))
                done = checkpoint(done.unionByName(along))
                ids = maps.select("id")
                open_ = open_.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "tgt", "w")
                open_ = open_.unionByName(maps.select(F.col("id").alias("src"), F.col("prev").alias("tgt"), "w"))
                rest = rest.join(ids, "id", "left_anti").select("id", "floor").unionByName(maps.select("id", "floor"))
        out = done if out is None else out.unionByName(done)
        known = open_.join(done.select(F.col("id").alias("tgt"), "level"), "tgt").groupBy(F.col("src").alias("id")).agg(F.max(F.col("level") + F.col("w")).alias("least"))
        rest = rest.join(done.select("id"), "id", "left_anti").join(known, "id", "left")
        rest = checkpoint(rest.select("id", F.greatest("floor", F.coalesce("least", "floor")).alias("floor")))
        gone = done.select("id")
        open_ = checkpoint(open_.join(gone.withColumnRenamed("id", "tgt"), "tgt", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "tgt", "w"))
    rest = rest.select("id", F.lit(None).cast("int").alias("level"))
    return rest if out is None else out.select("id", F.col("level").cast("int").alias("level")).unionByName(rest)


def _composed(rest: DataFrame, open_: DataFrame) -> DataFrame | None:
    """id, prev, w, floor of the nodes with one open precedent, led back to the first node that has none or several; None if too few are chained."""
    one = open_.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("tgt").alias("prev"), F.max("w").alias("w")).where("n = 1")
    maps = checkpoint(one.join(rest, "id").select("id", "prev", "w", "floor"))
    if maps.join(maps.select(F.col("id").alias("prev")), "prev", "left_semi").count() < CHAINED:
        return None
    # More rounds than the logarithm of all maps are needed on rings only, which never get a level.
    for _ in range(maps.count().bit_length() + 1):
        on = maps.select(F.col("id").alias("prev"), F.col("prev").alias("prev2"), F.col("w").alias("w2"), F.col("floor").alias("floor2"))
        w, joined = F.col("w"), maps.join(on, "prev", "left")
        floor = F.greatest("floor", F.coalesce(F.col("floor2") + w, F.col("floor")))
        moved = F.col("prev2").isNotNull()
        maps = checkpoint(joined.select("id", F.coalesce("prev2", "prev").alias("prev"), (w + F.coalesce("w2", F.lit(0))).alias("w"), floor.alias("floor"), moved.alias("moved")))
        if maps.where("moved").isEmpty():
            break
    return maps.drop("moved")


def has_cycle(edges: DataFrame) -> bool:
    return not levels(edges).where("level IS NULL").isEmpty()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both a precedent and a dependent, again and again. What hangs on for more than a few rounds is
    found by its levels, from either end."""
    n = None
    for _ in range(LOOKED):
        inner = edges.join(edges.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
        inner = checkpoint(inner.join(edges.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").select("src", "tgt"))
        now = inner.count()
        if now == n or not now:
            return inner
        edges, n = inner, now
    for _ in range(2):
        held = levels(edges).where("level IS NULL").select("id")
        edges = edges.join(held.withColumnRenamed("id", "src"), "src", "left_semi").join(held.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
        edges = checkpoint(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    return edges


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least label among a node and all that reach it along the edges src -> tgt."""
    total = None
    while True:
        come = edges.join(nodes.withColumnRenamed("id", "src"), "src").groupBy(F.col("tgt").alias("id")).agg(F.min("label").alias("new"))
        nodes = checkpoint(nodes.join(come, "id", "left").select("id", F.least("label", F.coalesce("new", "label")).alias("label")))
        now = nodes.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return nodes
        total = now


def _coloured(edges: DataFrame) -> DataFrame:
    """id, scc: members of strongly connected components of two or more nodes, named by their least member.

    Each round colours every node by the least node that reaches it, then goes back from the roots inside their
    colour: what a root reaches and what reaches it is one component. Found components leave the graph."""
    out = None
    while True:
        edges = _trimmed(edges)
        if edges.isEmpty():
            break
        ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("tgt").alias("id"))).distinct()
        colour = _spread(ids.withColumn("label", F.col("id")), edges)
        same = edges.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("tgt"), F.col("label").alias("b")), "tgt")
        inside = checkpoint(same.where("a = b").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
        found = colour.where("id = label").select("id", F.col("label").alias("scc"))
        frontier = found
        while True:
            step = inside.join(frontier.select(F.col("id").alias("src"), "scc"), "src").select(F.col("tgt").alias("id"), "scc").distinct()
            frontier = checkpoint(step.join(found.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            found = checkpoint(found.unionByName(frontier))
        many = found.groupBy("scc").count().where("count > 1").select("scc")
        members = checkpoint(found.join(many, "scc", "left_semi").select("id", "scc"))
        out = members if out is None else out.unionByName(members)
        gone = found.select("id")
        edges = checkpoint(
            edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "tgt"), "tgt", "left_anti").select("src", "tgt")
        )
    return out if out is not None else edges.select(F.col("src").alias("id"), F.col("tgt").alias("scc")).limit(0)


def components(edges: DataFrame) -> DataFrame:
    """id, scc: members of strongly connected components of two or more nodes, named by their least member.

    Nodes on a path without branches are on a cycle with its two ends or not at all, so such paths become edges first, and rings
    without branches are components as they are."""
    edges = _trimmed(checkpoint(edges.where("src <> tgt").select("src", "tgt").distinct()))
    down = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("tgt").alias("prev")).where("n = 1")
    up = edges.groupBy(F.col("tgt").alias("id")).agg(F.count(F.lit(1)).alias("m"), F.min("src").alias("next")).where("m = 1")
    plain = checkpoint(down.join(up, "id").select("id", "prev", "next"))
    if plain.join(plain.select(F.col("id").alias("prev")), "prev", "left_semi").count() < CHAINED:
        return _coloured(edges)
    back = _ends(plain.select("id", "prev"))
    rings = back.where("open").select("id", F.col("least").alias("scc"))
    paths = back.where("NOT open").select("id", F.col("end").alias("low"))
    ahead = plain.join(rings, "id", "left_anti").select("id", F.col("next").alias("prev"))
    paths = checkpoint(paths.join(_ends(ahead).select("id", F.col("end").alias("high")), "id"))
    inner = plain.select("id")
    kept = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_anti").join(inner.withColumnRenamed("id", "tgt"), "tgt", "left_anti").select("src", "tgt")
    short = checkpoint(kept.unionByName(paths.select(F.col("high").alias("src"), F.col("low").alias("tgt"))).distinct())
    found = _coloured(checkpoint(short.where("src <> tgt")))
    alone = short.where("src = tgt").select(F.col("src").alias("id"), F.col("src").alias("scc")).join(found.select("id"), "id", "left_anti")
    found = checkpoint(found.unionByName(alone))
    ends = [found.select(F.col("id").alias(c), F.col("scc").alias(f"scc_{c}")) for c in ("low", "high")]
    between = paths.join(ends[0], "low").join(ends[1], "high").where("scc_low = scc_high").select("id", F.col("scc_low").alias("scc"))
    whole = checkpoint(found.unionByName(between))
    names = whole.groupBy("scc").agg(F.min("id").alias("name"))
    return checkpoint(whole.join(names, "scc").select("id", F.col("name").alias("scc")).unionByName(rings))


def short_cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """cycle (sorted members), length: simple cycles of two to `longest` nodes, each once, found inside components.
    Paths start at a cycle's least member, so none is walked twice."""
    comp = components(edges)
    inner = edges.select("src", "tgt").distinct().join(comp.withColumnRenamed("id", "src"), "src")
    inner = inner.join(comp.select(F.col("id").alias("tgt"), F.col("scc").alias("scc2")), "tgt").where("scc = scc2")
    inner = checkpoint(inner.select("src", "tgt"))
    paths = inner.where("tgt > src").select(F.array("src", "tgt").alias("path"), F.col("src").alias("first"), F.col("tgt").alias("last"))
    out = None
    for length in range(2, longest + 1):
        closed = paths.join(inner, (paths["last"] == inner["src"]) & (paths["first"] == inner["tgt"]), "left_semi")
        closed = closed.select(F.array_sort("path").alias("cycle"), F.lit(length).alias("length")).distinct()
        out = closed if out is None else out.unionByName(closed)
        if length < longest:
            longer = paths.join(inner, paths["last"] == inner["src"]).where((F.col("tgt") > F.col("first")) & ~F.array_contains("path", F.col("tgt")))
            paths = checkpoint(longer.select(F.concat("path", F.array("tgt")).alias("path"), "first", F.col("tgt").alias("last")))
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, most_seeds: int = 80, most_others: int = 70, most_edges: int = 500) -> DataFrame:
    """The edges around some nodes, for a picture: at most so many seeds, further neighbours and edges, the first by name."""
    chosen = seeds.select("id").distinct().orderBy("id").limit(most_seeds)
    out = edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("tgt").alias("id"))
    back = edges.join(chosen.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select(F.col("src").alias("id"))
    others = out.unionByName(back).distinct().join(chosen, "id", "left_anti").orderBy("id").limit(most_others)
    shown = checkpoint(chosen.unionByName(others))
    inside = edges.join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    return inside.select("src", "tgt").distinct().orderBy("src", "tgt").limit(most_edges)
