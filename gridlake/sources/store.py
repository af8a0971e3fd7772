"""Graphs as JSON and as property-graph tables, and the registry of uploads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "id string, type string, data string"
EDGE = "source string, target string, relation string, fragment string, role string, period string"
UPLOAD = "id long, filename string, file_hash string, upload_time timestamp, status string, sheet_count long, cell_count long, formula_count long, graph_path string, error string"
VERSION = "id long, upload_id long, version_name string, created_at timestamp, graph_path string"
COMPARISON = "id long, version_a long, version_b long, diff_path string, created_at timestamp"


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON line for each node and edge, in two folders; written by all executors."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with a type (others are left out) and edges, with defaults for what is missing."""
    nodes = spark.read.schema(NODE).json(f"{path}/nodes").where("type IS NOT NULL")
    edges = spark.read.schema(EDGE).json(f"{path}/edges")
    return nodes, edges.fillna({"relation": "DEPENDS_ON", "fragment": "", "role": "", "period": ""})


def one_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as one JSON text, for small graphs."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "type", "data"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in EDGE.split(", ")]))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def property_graph(cells: DataFrame, items: DataFrame, edges: DataFrame, path: str, batch: int = 100) -> int:
    """Node and edge tables for a graph database, without dangling edges; returns how many batches of `batch` rows a loader
    would send."""
    ids = cells.select("id").unionByName(items.select("id")).distinct()
    whole = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    tables = {"Cell": cells.dropDuplicates(["id"]), "BusinessItem": items.dropDuplicates(["id"])}
    sizes = []
    for label, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
        sizes.append(df.count())
    whole.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    sizes += [r["count"] for r in whole.groupBy("relation").count().collect()]
    return sum(math.ceil(n / batch) for n in sizes)


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], UPLOAD)


def add_uploads(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with the new files (filename, file_hash, upload_time) whose hash it does not hold; ids go on from the highest.
    Of files with one hash the first by time and name is taken."""
    w = Window.partitionBy("file_hash").orderBy("upload_time", "filename")
    fresh = new.withColumn("k", F.row_number().over(w)).where("k = 1").join(registry, "file_hash", "left_anti")
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    order = Window.orderBy("upload_time", "filename", "file_hash")  # new uploads only
    rows = fresh.crossJoin(top).withColumn("id", F.col("top") + F.row_number().over(order))
    known = {"id", "filename", "file_hash", "upload_time"}
    cols = [F.col(f.name) if f.name in known else F.lit("pending" if f.name == "status" else None).cast(f.dataType).alias(f.name) for f in registry.schema]
    return registry.unionByName(rows.select(*cols))


def update_upload(registry: DataFrame, upload: int, **values: object) -> DataFrame:
    def new(name: str) -> Column:
        if name not in values:
            return F.col(name)
        return F.when(F.col("id") == upload, F.lit(values[name]).cast(registry.schema[name].dataType)).otherwise(F.col(name)).alias(name)

    return registry.select(*[new(c) for c in registry.columns])


def uploads(registry: DataFrame, n: int | None = None) -> DataFrame:
    rows = registry.orderBy(F.desc("upload_time"), F.desc("id"))
    return rows if n is None else rows.limit(n)


def add_version(versions: DataFrame, registry: DataFrame, upload: int, name: str) -> DataFrame:
    """`versions` with a further one of an upload, under the next id; unchanged if there is no such upload."""
    top = versions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))  # one row
    row = registry.where(F.col("id") == upload).select(F.col("id").alias("upload_id"), F.lit(name).alias("version_name"), F.current_timestamp().alias("created_at"), "graph_path")
    return versions.unionByName(row.crossJoin(top).select(*versions.columns))


def add_comparison(comparisons: DataFrame, versions: DataFrame, a: int, b: int, path: str) -> DataFrame:
    """`comparisons` with one of two versions that both exist, under the next id."""
    top = comparisons.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))  # one row
    both = versions.where(F.col("id").isin(a, b)).agg(F.countDistinct("id").alias("n")).where(F.col("n") == len({a, b}))
    row = both.select(F.lit(a).cast("long").alias("version_a"), F.lit(b).cast("long").alias("version_b"), F.lit(path).alias("diff_path"), F.current_timestamp().alias("created_at"))
    return comparisons.unionByName(row.crossJoin(top).select(*comparisons.columns))
