"""A model that is kept up to date: edits move what depends on them, and nothing beyond what does not move.

The model is evaluated once. Its formulas, their references, the levels of the dependency graph, the aggregates of range tiles and all values are written
in folders by hashes of their keys, so that a batch of edits reads the folders of what it touches. A batch goes up the levels: what
depends on a cell that moved is computed again, from current values; where the result is the old one, nothing above it is looked at. A range's tile is not
summed again: sums and counts change by what its cells change by, and a least or greatest value only is looked up anew where the cell that held it has
moved. Formulas on cycles or behind them, and what is still open after ROUNDS levels (long chains), are evaluated as `evaluate` does.

New values lie over the written ones in a small table, which is merged into them, tiles summed afresh, when it holds MERGED of all values. So a batch costs
what it changes, and what has changed since the last merge. Lookups (MATCH, COUNTIF, ...) whose range moved read the values of all cells again, and the
table of which tiles a range has is read as a whole.
"""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators import evaluate as E
from gridlake.operators import graph, ranges

#: Levels of one batch before the rest is evaluated at once; the part of all values that may lie over the written ones.
ROUNDS, MERGED = 12, 0.1
#: Rows that one folder should hold, and how many folders there may be: their numbers come to the driver.
HELD, FOLDERS = 200_000, 256

VALUE = ["id", "v_num", "v_str"]
MOVED = ["id", "old_num", "old_str", "new_num", "new_str"]


class _Kept:
    """A table in folders by the hash of a key."""

    def __init__(self, table: DataFrame, key: str) -> None:
        self.key, self.rows = key, table.count()
        self.folders = max(1, min(FOLDERS, self.rows // HELD))
        placed = table.withColumn("_folder", self._folder())
        self.table = graph.checkpoint(placed.repartition(self.folders, "_folder") if self.folders > 1 else placed, "_folder")

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among `keys` (a column of that name)."""
        at = self.table
        if self.folders > 1:
            at = at.where(F.col("_folder").isin([r[0] for r in keys.select(self._folder()).distinct().collect()]))
        return at.drop("_folder").join(keys.select(self.key).distinct(), self.key, "left_semi")


def _last(edits: DataFrame) -> DataFrame:
    """The last edit of each cell by ts, if there is one; otherwise, and of those of one time, the greatest value."""
    at = [F.col("ts")] if "ts" in edits.columns else []
    value = F.struct(F.col("v_num").cast("double").alias("v_num"), F.col("v_str").cast("string").alias("v_str"))
    return edits.where("id IS NOT NULL").groupBy("id").agg(F.max_by(value, F.struct(*at, value)).alias("v")).select("id", "v.v_num", "v.v_str")


def _named(tile: str) -> list[Column]:
    """TILE out of the name that tiles have among the nodes; sheets may hold any sign."""
    found = lambda k: F.regexp_extract(tile, r"(?s)^tile:(.*)!(\d+)!(\d+)!(\d+)!(\d+)$", k)
    return [found(1).alias("sheet"), *(found(k + 1).cast("int").alias(c) for k, c in enumerate(ranges.TILE) if k)]


class Live:
    """`cells` as `evaluate.with_ids` gives them; stored values of formulas count on cycles only, where iteration starts from them."""

    def __init__(self, cells: DataFrame) -> None:
        self._cells = graph.checkpoint(cells)
        model, values = E.nodes_and_values(self._cells)
        values = graph.checkpoint(values.select(*VALUE))
        edges = graph.checkpoint(model.edges(values.select("id")))
        self._model = model
        self._nodes, self._singles = _Kept(model.nodes, "id"), _Kept(model.singles, "src")
        levels = graph.levels(edges).withColumnRenamed("id", "src")
        #: src, tgt, level of src: by tgt, for going up.
        self._above = _Kept(edges.join(levels, "src", "left"), "tgt")
        self._values, self._over = _Kept(values, "id"), graph.checkpoint(values.limit(0))
        #: Formula cells that an edit has given a value.
        self._fixed = graph.checkpoint(values.select("id").limit(0))
        self._sum_tiles()

    def _sum_tiles(self) -> None:
        self._sums = graph.checkpoint(E.tile_sums(self._model.inside, self._values.table.drop("_folder"))) if self._model.has_ranges else None

    def _all(self) -> DataFrame:
        return self._values.table.drop("_folder").join(self._over, "id", "left_anti").unionByName(self._over)

    def _now(self, ids: DataFrame) -> DataFrame:
        over = self._over.join(ids.select("id"), "id", "left_semi")
        return self._values.of(ids).join(over, "id", "left_anti").unionByName(over)

    @property
    def cells(self) -> DataFrame:
        """All cells as they are now."""
        old = self._cells.drop("v_num", "v_str").join(self._all(), "id")
        return old.join(self._fixed.withColumn("_set", F.lit(True)), "id", "left").select("id", *E.KEY, "v_num", "v_str", F.when(F.col("_set").isNull(), F.col("formula_raw")).alias("formula_raw"))

    def _set(self, new: DataFrame) -> DataFrame:
        """Lays new values over the old ones; MOVED of those that differ."""
        old = self._now(new).select("id", F.col("v_num").alias("old_num"), F.col("v_str").alias("old_str"))
        both = new.select("id", F.col("v_num").alias("new_num"), F.col("v_str").alias("new_str")).join(old, "id")
        moved = graph.checkpoint(both.where(~(F.col("old_num").eqNullSafe(F.col("new_num")) & F.col("old_str").eqNullSafe(F.col("new_str")))).select(*MOVED))
        over = moved.select("id", F.col("new_num").alias("v_num"), F.col("new_str").alias("v_str"))
        self._over = graph.checkpoint(self._over.join(over, "id", "left_anti").unionByName(over))
        return moved

    def apply(self, edits: DataFrame) -> DataFrame:
        """Sets `edits` (id, v_num, v_str; the last by ts, if there is one, of each cell) and returns MOVED of what else changes. Cells that the model does not have are left out; an
        edited formula is a value from now on."""
        last = graph.checkpoint(_last(edits).join(self._cells.select("id"), "id", "left_semi"))
        formulas = self._nodes.of(last).select("id")
        self._fixed = graph.checkpoint(self._fixed.unionByName(formulas).distinct())
        moved = self._set(last)
        out, done = moved, None
        pending = graph.checkpoint(self._up(moved))
        for _ in range(ROUNDS):
            low = pending.agg(F.min("level")).first()[0]
            if low is None:
                break
            todo = graph.checkpoint(pending.where(F.col("level") == low).select("id"))
            tiles = graph.checkpoint(todo.where("startswith(id, 'tile:')"))
            if not tiles.isEmpty():
                self._change_tiles(tiles, out)
                done = tiles if done is None else done.unionByName(tiles)
            moved = self._computed(todo)
            out = out.unionByName(moved)
            # A tile of which a cell moved may have moved; what depends on it is computed.
            higher = self._up(moved.select("id").unionByName(tiles))
            pending = graph.checkpoint(pending.where(F.col("level").isNull() | (F.col("level") > low)).unionByName(higher).distinct())
        if not pending.isEmpty():
            out = out.unionByName(self._evaluated(pending.select("id")))
            if self._model.has_ranges:
                held = self._above.of(out.select(F.col("id").alias("tgt"))).where("startswith(src, 'tile:')").select(F.col("src").alias("id")).distinct()
                self._change_tiles(graph.checkpoint(held if done is None else held.join(done, "id", "left_anti")), out)
        if self._over.count() > MERGED * self._values.rows:
            self._values, self._over = _Kept(self._all(), "id"), self._over.limit(0)
            self._sum_tiles()
        # Values of calls inside formulas have ids of their own.
        return out.join(last.select("id"), "id", "left_anti").join(self._cells.select("id"), "id", "left_semi")

    def _up(self, moved: DataFrame) -> DataFrame:
        """id, level of what depends on the nodes `moved`."""
        return self._above.of(moved.select(F.col("id").alias("tgt"))).select(F.col("src").alias("id"), "level").distinct()

    def _computed(self, todo: DataFrame) -> DataFrame:
        """Computes the formulas among `todo` from current values; MOVED of those that differ."""
        nodes = graph.checkpoint(self._nodes.of(todo).join(self._fixed.withColumnRenamed("id", "cell"), "cell", "left_anti").select(self._model.nodes.columns))
        if nodes.isEmpty():
            return self._over.limit(0).select("id", *(F.lit(None).cast(t).alias(c) for c, t in zip(MOVED[1:], ("double", "string") * 2, strict=True)))
        mine = copy.copy(self._model)
        mine.singles, mine.sums = graph.checkpoint(self._singles.of(nodes.select(F.col("id").alias("src"))).select(self._model.singles.columns)), self._sums
        looks = not nodes.where("kind <> 'value'").isEmpty()
        values = self._all() if looks else self._now(mine.singles.select(F.col("tgt").alias("id")).distinct())
        return self._set(graph.checkpoint(E._step(mine, nodes, values)))

    def _change_tiles(self, tiles: DataFrame, moved: DataFrame) -> None:
        """Changes the aggregates of the tiles (id) by what the cells in them have `moved`."""
        inside = self._above.of(moved.select(F.col("id").alias("tgt"))).join(tiles.select(F.col("id").alias("src")), "src", "left_semi")
        rows = inside.select("src", F.col("tgt").alias("id")).join(moved, "id")
        old, new = E.parts_of_value("old_num", "old_str"), E.parts_of_value("new_num", "new_str")
        added = lambda c: F.sum(F.coalesce(new[c], F.lit(0.0)) - F.coalesce(old[c], F.lit(0.0))).alias(f"d_{c}")
        counts = [c for c in E.AGGREGATES if c not in ("lo", "hi")]
        gone = [F.min(old["lo"]).alias("gone_lo"), F.max(old["hi"]).alias("gone_hi"), F.min(new["lo"]).alias("new_lo"), F.max(new["hi"]).alias("new_hi")]
        change = rows.groupBy("src").agg(*[added(c) for c in counts], *gone).select(*_named("src"), "*").drop("src")
        change = graph.checkpoint(change)
        both = self._sums.join(change, ranges.TILE, "full_outer")
        lost = (F.col("gone_lo") <= F.col("lo")) | (F.col("gone_hi") >= F.col("hi"))
        sums = {c: F.coalesce(c, F.lit(0.0)) + F.coalesce(f"d_{c}", F.lit(0.0)) for c in counts}
        # Without a number in it a tile has no total.
        total = F.when(sums["cells"] > sums["bad"], sums["total"])
        kept = both.select(*ranges.TILE, total.alias("total"), F.least("lo", "new_lo").alias("lo"), F.greatest("hi", "new_hi").alias("hi"), *(sums[c].alias(c) for c in counts if c != "total"), F.coalesce(lost, F.lit(False)).alias("lost"))
        kept = graph.checkpoint(kept)
        again = kept.where("lost").select(*ranges.TILE)
        if again.isEmpty():
            self._sums = kept.drop("lost").where("cells > 0")
            return
        cells = self._model.inside.join(again, ranges.TILE, "left_semi")
        afresh = E.tile_sums(cells, self._now(cells.select("id").distinct()))
        self._sums = graph.checkpoint(kept.where("NOT lost AND cells > 0").drop("lost").unionByName(afresh.select(kept.drop("lost").columns)))

    def _evaluated(self, start: DataFrame) -> DataFrame:
        """Evaluates all that depends on `start`, and that itself; MOVED of what differs."""
        edges = self._above.table.select("src", "tgt")
        reached = graph.checkpoint(graph.reached(edges, start).join(self._cells.select("id"), "id", "left_semi"))
        # Calls inside formulas are nodes below their cells, which depend on them.
        model, values = E.nodes_and_values(graph.checkpoint(self.cells), reached)
        return self._set(graph.checkpoint(values.join(model.nodes.select("id"), "id", "left_semi").select(*VALUE)))
