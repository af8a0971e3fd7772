"""A workbook's whole graph: nodes, edges and items of its cell table, and what differs between two workbooks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import formula
from gridlake.operators import diff, evaluate, items
from gridlake.operators.evaluate import cell_id


class Graph(NamedTuple):
    #: id, type (cell, business_item), data
    nodes: DataFrame
    #: source, target, relation, fragment, role, period
    edges: DataFrame
    items: DataFrame


def _column(letters: Column) -> Column:
    """Number of a column by its letters."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))


def loose_edges(parsed: DataFrame) -> DataFrame:
    """src, tgt of formulas that cannot be read: the cells they still name. `parsed` as `formula.parsed` gives it."""
    named = parsed.where("error IS NOT NULL").select(F.col("id").alias("src"), "sheet", F.explode(F.regexp_extract_all("formula_raw", F.lit(formula.LOOSE), F.lit(0))).alias("text"))
    part = lambda k: F.regexp_extract("text", formula.LOOSE, k)
    plain = F.regexp_replace(F.regexp_replace(part(1), "^'|'$", ""), "''", "'")
    sheet = F.coalesce(F.nullif(plain, F.lit("")), F.col("sheet"))
    return named.select("src", cell_id(sheet, part(3).cast("int"), _column(F.upper(part(2)))).alias("tgt"))


def dependencies(cells: DataFrame) -> DataFrame:
    """src, tgt: what formulas name, read or not, among cells that exist; each pair once."""
    parsed = formula.parsed(cells)
    loose = loose_edges(parsed).join(cells.select(F.col("id").alias("tgt")), "tgt", "left_semi").select("src", "tgt")
    return evaluate.edges_of(cells, parsed.where("error IS NULL")).unionByName(loose).distinct()


def build(cells: DataFrame) -> Graph:
    """The graph of a cell table as `evaluate.with_ids` gives it: formulas depend on what they name, cells belong to items."""
    found = items.items(cells)
    empty = F.lit("")
    depend = dependencies(cells).select(
        F.col("src").alias("source"), F.col("tgt").alias("target"), F.lit("DEPENDS_ON").alias("relation"), empty.alias("fragment"), empty.alias("role"), empty.alias("period")
    )
    node = lambda df, key, kind: df.select(F.col(key).alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("data"))
    nodes = node(cells, "id", "cell").unionByName(node(found, "item_id", "business_item"))
    return Graph(nodes, depend.unionByName(items.item_edges(found)), found)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """part (cells, items), added, removed, modified, unchanged of two workbooks' cell tables. Cells are compared by place, items by
    name and the number of their value cell; of items with one name the last one counts."""
    cells = diff.counts(diff.diff(old, new, ["id"], ["v_num", "v_str", "formula_raw"]))
    last = lambda df: items.valued(items.items(df), df).groupBy("name").agg(F.max_by("value", F.struct("sheet", "row")).alias("value"))
    named = diff.counts(diff.diff(last(old), last(new), ["name"], ["value"]))
    return cells.select(F.lit("cells").alias("part"), *diff.STATES).unionByName(named.select(F.lit("items").alias("part"), *diff.STATES))
