"""Ranges of cells without listing their cells: dyadic tiles.

A tile is a rectangle whose sides are powers of two and which starts at a multiple of them. Every rectangle is a union of
disjoint tiles, at most two for each power in either direction, so a range of n rows is covered by 2 log n of them
however long it is, and ranges that overlap, as running sums do, share their tiles. Cells find the tiles they lie in by an equi-join, for the
sizes that occur only; each tile is aggregated once for all ranges that it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that a side of a tile may have: sheets hold up to 2 ** 20 rows and 2 ** 14 columns, but tables that stand for a sheet hold more rows.
ROW_POWERS, COL_POWERS = 31, 15

RECT = ["sheet", "row", "col", "end_row", "end_col"]
TILE = ["sheet", "row_power", "row_tile", "col_power", "col_tile"]


def _cover(first: Column, last: Column, powers: int) -> Column:
    """Disjoint intervals [at * 2^power, (at + 1) * 2^power) that make up first..last; none if it ends before it starts."""

    def at(k: Column) -> Column:
        size = F.element_at(F.array(*[F.lit(1 << p) for p in range(powers)]), k + 1)
        left, right = F.ceil(first / size), F.floor((last + 1) / size)
        one = lambda when, place: F.when((left < right) & when, F.struct(k.alias("power"), place.cast("int").alias("tile")))
        return F.array(one(left % 2 == 1, left), one(right % 2 == 1, right - 1))

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(powers - 1)), at))
    return F.filter(found, lambda x: x.isNotNull())


def tiles_of(rects: DataFrame) -> DataFrame:
    """The columns of `rects` with row_power, row_tile, col_power, col_tile: a row for each tile of the cover."""
    rows = rects.withColumn("_r", F.explode(_cover(F.col("row"), F.col("end_row"), ROW_POWERS)))
    both = rows.withColumn("_c", F.explode(_cover(F.col("col"), F.col("end_col"), COL_POWERS)))
    named = {"row_power": "_r.power", "row_tile": "_r.tile", "col_power": "_c.power", "col_tile": "_c.tile"}
    return both.withColumns({k: F.col(v) for k, v in named.items()}).drop("_r", "_c")


def cells_in(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """TILE and the columns of `cells` (sheet, row, col_ix, ...): the cells of each of the tiles (distinct rows of TILE)."""
    # At most ROW_POWERS * COL_POWERS sizes; usually one for each power of two up to the longest range.
    sizes = tiles.select("row_power", "col_power").distinct().collect()
    if not sizes:
        sizes = [(0, 0)]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in sizes]))
    spread = cells.withColumn("_s", each).withColumns({"row_power": F.col("_s.r"), "col_power": F.col("_s.c")})
    placed = spread.withColumns({"row_tile": F.expr("shiftright(row, row_power)"), "col_tile": F.expr("shiftright(col_ix, col_power)")}).drop("_s")
    return placed.join(tiles.select(*TILE), TILE, "left_semi")
