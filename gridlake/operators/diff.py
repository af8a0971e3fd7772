"""Differences between two versions of a table of cells or items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("added", "removed", "modified", "unchanged")


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, status and old_<v>, new_<v>: one full outer join on the keys."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("in_old"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("in_new"))
    same: Column = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("in_old", "in_new")


def counts(diffs: DataFrame, *by: str) -> DataFrame:
    return diffs.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def summary(diffs: DataFrame, old_name: str, new_name: str) -> DataFrame:
    """One row: the four counts, total_changes and a line of text."""
    text = F.format_string(f"{old_name} vs {new_name}: +%d / -%d / ~%d (%d unchanged)", *STATES)
    return counts(diffs).select(*STATES, (F.col("added") + F.col("removed") + F.col("modified")).alias("total_changes"), text.alias("summary"))


def last_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last by `order`: how named items with duplicates are read."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
