"""Evaluation of formula cells, what-if recalculation, and cyclic models, as joins and column expressions.

Cells: sheet, row, col_ix, v_num, v_str, formula_raw. Each formula becomes nodes (see `compile`): itself, and one for each
call that looks into a range. Nodes of one shape, whatever cells they name, are computed by one expression in the JVM; only
IRR and XIRR, which iterate, run in Python. Values of single references come by an equi-join; aggregates of ranges from dyadic tiles that all ranges
share (`ranges`); lookups from one dictionary for each looked-up range (`lookup`).

Nodes are computed in rounds, those whose precedents are known first. A round writes its new values and
nothing else. Where formulas hang one to the next, each linear in the one before it, as in a roll-forward, their maps
x -> a x + b are composed by pointer doubling, so a chain of any length takes the logarithm of it. What lies on cycles is iterated together, all
cycles at once, from stored values, until each has settled or is marked `#CIRC!`. A recalculation does the same for what depends on the edited cells only.
"""

from __future__ import annotations

import copy
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridlake.functions import compile as C
from gridlake.functions import formula
from gridlake.functions import library as L
from gridlake.functions.coerce import NA, NUM, REF
from gridlake.operators import graph, lookup, ranges

KEY = ["sheet", "row", "col_ix"]
#: Sweeps over cycles, of which each sees the values of the one before it, and how little a value may move at the end; sweeps of one plan.
ITERATIONS, TOLERANCE, UNROLLED = 200, 1e-6, 10
#: Chains are composed where so many formulas hang to another one that is open; shapes that one projection holds.
CHAINED, SHAPES = 50, 16
#: Every so many rounds chains are looked for.
LOOKED = 4


def cell_id(*cols: str):
    return F.concat_ws("!", *cols)


def with_ids(cells: DataFrame) -> DataFrame:
    return cells.select(cell_id(*KEY).alias("id"), *KEY, F.col("v_num").cast("double").alias("v_num"), "v_str", "formula_raw")


def programs(cells: DataFrame) -> DataFrame:
    """id, sheet, program, refs, error of formula cells. `cells` as `with_ids` gives them."""
    return formula.parsed(cells).select("id", "sheet", "v_num", "v_str", "program", "refs", "error")


def _read(cells: DataFrame) -> DataFrame:
    """id, sheet, nodes (see `compile`) of formula cells; a formula that cannot be read has no nodes."""
    return cells.join(formula.texts(cells).select("formula_raw", C.nodes("formula_raw").alias("nodes")), "formula_raw").select("id", "sheet", "nodes")


def _rects(refs: DataFrame) -> DataFrame:
    """The references `r` as rectangles: `rect` names one, RECT are its sides; those that end before they start have none."""
    sheet = F.coalesce("r.sheet", "sheet")
    rect = cell_id(sheet, "r.row", "r.col", "r.end_row", "r.end_col").alias("rect")
    keep = [c for c in refs.columns if c not in ("r", "sheet")]
    return refs.where("r.row <= r.end_row AND r.col <= r.end_col").select(*keep, rect, sheet.alias("sheet"), *(F.col(f"r.{c}").alias(c) for c in ranges.RECT[1:]))


def edges_of(cells: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """src, tgt: the dependencies between cells that exist. Ranges find their cells by tiles. `parsed` has id, sheet, refs of the formulas."""
    parsed = programs(cells) if parsed is None else parsed
    refs = parsed.select(F.col("id").alias("src"), "sheet", F.explode("refs").alias("r"))
    single = refs.where("NOT r.is_range").select("src", cell_id(F.coalesce("r.sheet", "sheet"), "r.row", "r.col").alias("tgt"))
    single = single.join(cells.select(F.col("id").alias("tgt")), "tgt", "left_semi").select("src", "tgt")
    rects = graph.checkpoint(_rects(refs.where("r.is_range")))
    tiles = graph.checkpoint(ranges.tiles_of(rects.select("rect", *ranges.RECT).distinct()))
    inside = ranges.cells_in(tiles, cells.select("id", *KEY)).select(F.col("id").alias("tgt"), *ranges.TILE)
    several = tiles.join(inside, ranges.TILE).select("rect", "tgt").join(rects.select("src", "rect"), "rect").select("src", "tgt")
    return single.unionByName(several).distinct()


class _Model:
    """The nodes of a table of cells, and what they name. All tables are written."""

    #: Aggregates of tiles, where they are kept.
    sums: DataFrame | None = None

    def __init__(self, cells: DataFrame, parsed: DataFrame) -> None:
        cut = graph.checkpoint
        node = F.explode("nodes").alias("x")
        name = F.when(F.col("x.k") == 0, F.col("cell")).otherwise(F.concat_ws("#", "cell", "x.k"))
        self.nodes = cut(parsed.select(F.col("id").alias("cell"), "sheet", node).select(name.alias("id"), "cell", "sheet", "x.*"))
        shapes = self.nodes.select("kind", "shape").distinct().collect()
        #: As many as there are different structures of formulas.
        self.shapes = {k: sorted(r["shape"] for r in shapes if r["kind"] == k) for k in sorted({r["kind"] for r in shapes})}
        refs = self.nodes.select(F.col("id").alias("src"), "sheet", F.posexplode("refs").alias("at", "r"))
        single = refs.select("src", "at", cell_id(F.coalesce("r.sheet", "sheet"), "r.row", "r.col").alias("tgt"))
        parts = self.nodes.select(F.col("id").alias("src"), "cell", F.posexplode("parts").alias("at", "k")).select("src", (-1 - F.col("at")).alias("at"), F.concat_ws("#", "cell", "k").alias("tgt"))
        self.singles = cut(single.unionByName(parts))
        spans = self.nodes.select(F.col("id").alias("src"), "kind", "sheet", F.posexplode("ranges").alias("at", "r"))
        self.rects = cut(_rects(spans))
        self.has_ranges = not self.rects.isEmpty()
        if self.has_ranges:
            self.tiles = cut(ranges.tiles_of(self.rects.select("rect", *ranges.RECT).distinct()))
            self.inside = cut(ranges.cells_in(self.tiles, cells.select("id", *KEY)).withColumn("tile", cell_id(*ranges.TILE)).select("id", "row", "col_ix", "tile", *ranges.TILE))

    def edges(self, todo: DataFrame) -> DataFrame:
        """src, tgt between the nodes `todo` (id) and the tiles that hold some of them."""
        target = todo.select(F.col("id").alias("tgt"))
        single = self.singles.select("src", "tgt").join(target, "tgt", "left_semi").select("src", "tgt")
        if not self.has_ranges:
            return single.distinct()
        held = self.inside.join(todo.select("id"), "id", "left_semi").select(F.concat(F.lit("tile:"), "tile").alias("src"), F.col("id").alias("tgt"))
        tiles = self.tiles.select("rect", F.concat(F.lit("tile:"), cell_id(*ranges.TILE)).alias("tgt")).join(held.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi")
        wide = self.rects.select("src", "rect").join(tiles, "rect").select("src", "tgt")
        return single.unionByName(held).unionByName(wide).distinct()


def _env(model: _Model, todo: DataFrame, values: DataFrame) -> DataFrame:
    """src, env: the values of single references by their number; those of parts by -1 less theirs."""
    mine = model.singles.join(todo.select(F.col("id").alias("src")), "src", "left_semi").join(values.withColumnRenamed("id", "tgt"), "tgt")
    return mine.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct(F.col("v_num").alias("n"), F.col("v_str").alias("s"))))).alias("env"))


ENV = "map<int,struct<n:double,s:string>>"


AGGREGATES = ("total", "lo", "hi", "cells", "bad", "texts", "true")


def parts_of_value(num: str, text: str) -> dict[str, Column]:
    """What a cell adds to each aggregate; all null for a blank."""
    n, s = F.nanvl(num, F.lit(None).cast("double")), F.col(text)
    x, there = F.coalesce(n, s.try_cast("double")), n.isNotNull() | s.isNotNull()
    flag = lambda c: F.when(there, c.cast("double"))
    return {"total": x, "lo": x, "hi": x, "cells": flag(F.lit(1)), "bad": flag(x.isNull()), "texts": flag(s.isNotNull()), "true": flag(F.coalesce(s != "", n != 0, F.lit(False)))}


def tile_sums(inside: DataFrame, values: DataFrame) -> DataFrame:
    """TILE and AGGREGATES of the tiles that `inside` (TILE, id) lists the cells of."""
    held = inside.select("id", *ranges.TILE).join(values, "id").select(*ranges.TILE, *(c.alias(k) for k, c in parts_of_value("v_num", "v_str").items()))
    of = lambda c: F.min(c) if c == "lo" else F.max(c) if c == "hi" else F.sum(c)
    return held.where("cells = 1").groupBy(*ranges.TILE).agg(*[of(c).alias(c) for c in AGGREGATES])


def _stats(model: _Model, todo: DataFrame, values: DataFrame) -> DataFrame:
    """src, stats: the aggregates of ranges by their number. Each tile is aggregated once, then tiles make up ranges."""
    mine = model.rects.where("kind = 'value'").join(todo.select(F.col("id").alias("src")), "src", "left_semi")
    tiles = model.tiles.join(mine.select("rect").distinct(), "rect", "left_semi")
    by_tile = tile_sums(model.inside.join(tiles.select(*ranges.TILE).distinct(), ranges.TILE, "left_semi"), values) if model.sums is None else model.sums
    again = {c: F.min(c) if c == "lo" else F.max(c) if c == "hi" else F.sum(c) for c in AGGREGATES}
    by_rect = tiles.select("rect", *ranges.TILE).join(by_tile, ranges.TILE).groupBy("rect").agg(*[a.alias(c) for c, a in again.items()])
    area = ((F.col("end_row") - F.col("row") + 1) * (F.col("end_col") - F.col("col") + 1)).cast("double").alias("area")
    full = mine.select("src", "at", "rect", area).join(by_rect, "rect", "left")
    return full.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("area", *AGGREGATES)))).alias("stats"))


STATS = "map<int,struct<area:double,total:double,lo:double,hi:double,cells:double,bad:double,texts:double,true:double>>"


def _by_shape(rows: DataFrame, shapes: list[str], made, whole: bool | None = True) -> DataFrame:
    """`rows` with the columns that `made` gives for the tree of their shape (names and expressions), a few shapes in one projection. What the trees hold
    is computed first, stage by stage, but for their outermost call if they are not taken `whole`, and not at all if that is None."""
    out = None
    for k in range(0, len(shapes), SHAPES):
        trees = {s: json.loads(s) for s in shapes[k : k + SHAPES]}
        part = rows.where(F.col("shape").isin(list(trees))) if len(shapes) > SHAPES else rows
        stages, trees = ([], trees) if whole is None else C.bound(trees, whole)
        for stage in stages:
            part = part.withColumns({c: _picked(each) for c, each in stage.items()})
        each = {s: made(t) for s, t in trees.items()}
        part = part.withColumns({c: _picked({s: e[c] for s, e in each.items()}) for c in next(iter(each.values()))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _picked(each: dict[str, Column]) -> Column:
    """The expression of a row's shape."""
    out = F
    for shape, column in each.items():
        out = out.when(F.col("shape") == shape, column)
    return out


def _known(model: _Model, todo: DataFrame, values: DataFrame) -> DataFrame:
    """The nodes `todo` with env and stats."""
    rows = todo.join(_env(model, todo, values).withColumnRenamed("src", "id"), "id", "left")
    if not model.has_ranges or "value" not in model.shapes:
        return rows.withColumn("stats", F.lit(None).cast(STATS))
    return rows.join(_stats(model, todo, values).withColumnRenamed("src", "id"), "id", "left")


def _step(model: _Model, todo: DataFrame, values: DataFrame) -> DataFrame:
    """id, v_num, v_str of the nodes `todo`, of which there are some, from `values`. Only their own shapes are looked at."""
    present = todo.select("kind", "shape").distinct().collect()
    model = copy.copy(model)
    model.shapes = {k: sorted(r["shape"] for r in present if r["kind"] == k) for k in sorted({r["kind"] for r in present})}
    rows = _known(model, todo, values)
    out = []
    for kind, shapes in model.shapes.items():
        mine = rows.where(F.col("kind") == kind)
        if kind == "value":
            both = lambda tree: (lambda v: {"v_num": v.num, "v_str": v.txt})(C.value(tree))
            out.append(_by_shape(mine, shapes, both).select("id", "v_num", "v_str"))
        else:
            out.append(_LOOKUPS[kind](model, kind, _with_arguments(mine, shapes), values))
    return reduce(DataFrame.unionByName, out)


# Nodes that look into ranges ----------------------------------------------------------------------------------


def _with_arguments(rows: DataFrame, shapes: list[str]) -> DataFrame:
    """id, args: for each argument of the call its value (n, s), or the number of its range."""
    one = lambda n, s, r: F.struct(n.cast("double").alias("n"), s.cast("string").alias("s"), F.lit(r).cast("int").alias("range"))

    def made(tree: list) -> dict:
        each = []
        for a in tree[2:]:
            v = None if a[0] == "range" else C.value(a)
            each.append(one(C.no_num(), C.no_text(), a[1]) if v is None else one(v.num, v.txt, None))
        return {"args": F.array(*each)}

    return _by_shape(rows, shapes, made, whole=False).select("id", "args")


def _spans(model: _Model, asked: DataFrame, at: str) -> DataFrame:
    """`asked` with rect and its sides, of the range whose number is in the column `at`."""
    spans = model.rects.select(F.col("src").alias("id"), F.col("at").alias(at), "rect", *(F.col(c).alias(f"r_{c}") for c in ranges.RECT))
    return asked.join(spans, ["id", at], "left")


def _dictionary(model: _Model, spans: DataFrame, values: DataFrame, blanks: bool) -> DataFrame:
    """rect, at (place in the rectangle, from 1), n, s: the cells of the rectangles (rect, r_*) with values, each rectangle once; with `blanks`
    all of its places."""
    rects = spans.where("rect IS NOT NULL").select("rect", *(f"r_{c}" for c in ranges.RECT)).distinct()
    tiles = model.tiles.select("rect", *ranges.TILE).join(rects, "rect")
    place = (F.col("row") - F.col("r_row")) * (F.col("r_end_col") - F.col("r_col") + 1) + F.col("col_ix") - F.col("r_col") + 1
    n = F.nanvl("v_num", F.lit(None).cast("double"))
    cells = tiles.join(model.inside.drop("tile"), ranges.TILE).join(values, "id").where(n.isNotNull() | F.col("v_str").isNotNull())
    held = cells.select("rect", place.cast("int").alias("at"), n.alias("n"), F.col("v_str").alias("s"))
    if not blanks:
        return held
    area = (F.col("r_end_row") - F.col("r_row") + 1) * (F.col("r_end_col") - F.col("r_col") + 1)
    return rects.select("rect", F.explode(F.sequence(F.lit(1), area)).alias("at")).join(held, ["rect", "at"], "left")


def _conditional(model: _Model, kind: str, asked: DataFrame, values: DataFrame) -> DataFrame:
    """COUNTIF and SUMIF: equal cells of a range are counted once, sums over them made once, and rules that are equal asked once."""
    third = F.when(F.size("args") > 2, F.col("args")[2]["range"])
    asked = asked.select("id", F.col("args")[0]["range"].alias("at"), third.alias("add_at"), F.col("args")[1]["n"].alias("rule_n"), F.col("args")[1]["s"].alias("rule_s"))
    spans = _spans(model, asked, "at")
    add = model.rects.select(F.col("src").alias("id"), F.col("at").alias("add_at"), F.col("rect").alias("add"), *(F.col(c).alias(f"a_{c}") for c in ranges.RECT))
    spans = graph.checkpoint(spans.join(add, ["id", "add_at"], "left").withColumn("add", F.coalesce("add", "rect")))
    pairs = spans.select("rect", "add").distinct()
    number = F.coalesce("n", F.col("s").try_cast("double"), F.lit(0.0))
    held = graph.checkpoint(_counted(model, spans, values).join(pairs, "rect") if kind == "COUNTIF" else _summed(model, spans, pairs, values, number))
    rule_keys = ["rect", "add", "rule_n", "rule_s"]
    rules = spans.select(*rule_keys).distinct()
    wanted = F.regexp_extract("rule_s", "(?s)^(>=|<=|<>|>|<|=)", 1)
    plain = F.coalesce(F.col("rule_s").isNull() | ((wanted == "") & ~F.col("rule_s").rlike(r"[*?]") & (F.col("rule_s") != "")), F.lit(True))
    names = rules.columns
    equal = _equal(held, rules.where(plain)).select(*names, "many", "x")
    meets = rules.where(~plain).join(held.select("rect", "add", "n", "s", "many", "x"), ["rect", "add"])
    rest = F.expr("substring(rule_s, length(wanted) + 1)")
    limit = F.coalesce(rest.try_cast("double"), F.lit(0.0))
    compare = F.when(F.col("wanted") == ">=", number >= limit).when(F.col("wanted") == "<=", number <= limit).when(F.col("wanted") == "<>", number != limit).when(F.col("wanted") == ">", number > limit).when(F.col("wanted") == "<", number < limit).when(F.col("wanted") == "=", number == limit)
    quoted = F.regexp_replace("rule_s", r"([\\^$.|+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))
    shown = C.text(C.V(F.col("n"), F.col("s"), "any"))
    hit = F.when(F.col("wanted") != "", compare).when(F.col("rule_s") == "", shown == "").otherwise(F.expr("shown rlike pattern"))
    other = meets.withColumns({"wanted": wanted, "shown": shown, "pattern": pattern}).where(hit).select(*names, "many", "x")
    answer = equal.unionByName(other).groupBy(*names).agg(F.sum("many").cast("double").alias("many"), F.sum("x").alias("x"))
    same = reduce(Column.__and__, [spans[c].eqNullSafe(answer[c]) for c in rule_keys])
    out = spans.join(answer, same, "left").select(spans["id"], F.coalesce("many" if kind == "COUNTIF" else "x", F.lit(0.0)).alias("v_num"))
    return out.withColumn("v_str", F.lit(None).cast("string"))


def _counted(model: _Model, spans: DataFrame, values: DataFrame) -> DataFrame:
    """rect, n, s, many, x: how many cells of a range hold each value; its blank places are those that no cell with a value takes, and are not listed."""
    full = _dictionary(model, spans, values, blanks=False).groupBy("rect", "n", "s").agg(F.count(F.lit(1)).alias("many"))
    area = (F.col("r_end_row") - F.col("r_row") + 1).cast("long") * (F.col("r_end_col") - F.col("r_col") + 1)
    rects = spans.where("rect IS NOT NULL").select("rect", area.alias("area")).distinct()
    taken = full.groupBy("rect").agg(F.sum("many").alias("taken"))
    blank = rects.join(taken, "rect", "left").select("rect", C.no_num().alias("n"), C.no_text().alias("s"), (F.col("area") - F.coalesce("taken", F.lit(0))).alias("many"))
    return full.unionByName(blank.where("many > 0")).withColumn("x", F.lit(0.0))


def _summed(model: _Model, spans: DataFrame, pairs: DataFrame, values: DataFrame, number: Column) -> DataFrame:
    """rect, add, n, s, many, x: the sums over the places of the range `add` that hold numbers or texts, by what the same places of a range hold, blanks too."""
    others = spans.select(F.col("add").alias("rect"), *(F.coalesce(f"a_{c}", f"r_{c}").alias(f"r_{c}") for c in ranges.RECT))
    summed = _dictionary(model, others, values, blanks=False).select(F.col("rect").alias("add"), "at", number.alias("x"))
    # Places beyond the end of either range do not count.
    area = (F.col("r_end_row") - F.col("r_row") + 1).cast("long") * (F.col("r_end_col") - F.col("r_col") + 1)
    both = pairs.join(spans.where("rect IS NOT NULL").select("rect", area.alias("area")).distinct(), "rect")
    joined = summed.join(both, "add").where("at <= area").join(_dictionary(model, spans, values, blanks=False), ["rect", "at"], "left")
    return joined.groupBy("rect", "add", "n", "s").agg(F.count(F.lit(1)).alias("many"), F.sum("x").alias("x"))


def _equal(held: DataFrame, rules: DataFrame) -> DataFrame:
    """The groups of equal cells that a value without signs and wildcards is equal to, by a hash join; a blank rule means blank cells."""
    asked = rules.where("rule_s IS NOT NULL OR rule_n IS NOT NULL").withColumn("key", F.explode(lookup.keys_of_value(F.col("rule_n"), F.col("rule_s"))))
    cells = held.withColumn("key", F.explode(lookup.keys_of_cell(F.col("n"), F.col("s"))))
    found = asked.join(cells, ["rect", "add", "key"]).drop("key")
    blank = rules.where("rule_s IS NULL AND rule_n IS NULL").join(held.where("n IS NULL AND (s IS NULL OR s = '')"), ["rect", "add"])
    return found.dropDuplicates([*rules.columns, "n", "s"]).unionByName(blank.select(*found.columns))


def _match(model: _Model, kind: str, asked: DataFrame, values: DataFrame) -> DataFrame:
    args = F.col("args")
    how = F.when(F.size(args) > 2, F.coalesce(args[2]["n"], args[2]["s"].try_cast("double"), F.lit(0.0))).otherwise(0.0)
    spans = graph.checkpoint(_spans(model, asked.select("id", args[1]["range"].alias("at"), args[0]["n"].alias("n"), args[0]["s"].alias("s"), F.signum(how).cast("int").alias("kind")), "at"))
    found = lookup.matched(_dictionary(model, spans, values, blanks=True), spans.select("id", "rect", "n", "s", "kind"), "kind")
    return found.select("id", F.col("at").cast("double").alias("v_num"), F.when(F.col("at").isNull(), NA).alias("v_str"))


def _cell_values(asked: DataFrame, values: DataFrame) -> DataFrame:
    """id, v_num, v_str: the value of the cell `tgt`; where it is null, the error in `wrong`."""
    found = asked.join(values.select(F.col("id").alias("tgt"), "v_num", "v_str"), "tgt", "left")
    return found.select("id", "v_num", F.when(F.col("tgt").isNull(), F.col("wrong")).otherwise(F.col("v_str")).alias("v_str"))


def _index(model: _Model, kind: str, asked: DataFrame, values: DataFrame) -> DataFrame:
    """The cell in a row and column of a rectangle; in a single row or column one number is the place in it."""
    args = F.col("args")
    given = lambda k: F.coalesce(args[k]["n"], args[k]["s"].try_cast("double"), F.lit(0.0)).cast("int")
    rows = _spans(model, asked.select("id", args[0]["range"].alias("at"), given(1).alias("i"), F.when(F.size(args) > 2, given(2)).alias("j")), "at")
    height, width = F.col("r_end_row") - F.col("r_row") + 1, F.col("r_end_col") - F.col("r_col") + 1
    flat = (height == 1) & (F.coalesce("j", F.lit(1)) == 1)
    i, j = F.when(flat, 1).otherwise(F.col("i")), F.when(flat, F.col("i")).otherwise(F.coalesce("j", F.lit(1)))
    good = (i >= 1) & (i <= height) & (j >= 1) & (j <= width)
    tgt = F.when(good, cell_id("r_sheet", F.col("r_row") + i - 1, F.col("r_col") + j - 1))
    return _cell_values(rows.select("id", tgt.alias("tgt"), F.lit(REF).alias("wrong")), values)


def _vlookup(model: _Model, kind: str, asked: DataFrame, values: DataFrame) -> DataFrame:
    """MATCH in the first column, then the cell beside it."""
    args = F.col("args")
    close = F.when(F.size(args) > 3, C.truth(C.V(args[3]["n"], args[3]["s"], "any"))).otherwise(True)
    k = F.coalesce(args[2]["n"], args[2]["s"].try_cast("double"), F.lit(0.0)).cast("int")
    spans = _spans(model, asked.select("id", args[1]["range"].alias("at"), args[0]["n"].alias("n"), args[0]["s"].alias("s"), close.cast("int").alias("kind"), k.alias("k")), "at")
    spans = graph.checkpoint(spans)
    width = F.col("r_end_col") - F.col("r_col") + 1
    first = _dictionary(model, spans, values, blanks=True).join(spans.select("rect", width.alias("width")).distinct(), "rect").where("(at - 1) % width = 0")
    found = lookup.matched(first.select("rect", ((F.col("at") - 1) / F.col("width") + 1).cast("int").alias("at"), "n", "s"), spans.select("id", "rect", "n", "s", "kind"), "kind").select("id", "at")
    rows = spans.drop("at").join(found, "id")
    inside = F.col("at").isNotNull() & (F.col("k") >= 1) & (F.col("k") <= width)
    tgt = F.when(inside, cell_id("r_sheet", F.col("r_row") + F.col("at") - 1, F.col("r_col") + F.col("k") - 1))
    return _cell_values(rows.select("id", tgt.alias("tgt"), F.when(F.col("at").isNull(), NA).otherwise(REF).alias("wrong")), values)


def _in_order(model: _Model, kind: str, asked: DataFrame, values: DataFrame) -> DataFrame:
    """IRR, XIRR and CONCATENATE: all values of the ranges, row by row, in one array; the length of a series of flows bounds it."""
    rows = asked.select("id", F.posexplode("args").alias("place", "a")).select("id", "place", F.col("a.n").alias("arg_n"), F.col("a.s").alias("arg_s"), F.col("a.range").alias("at"))
    spans = graph.checkpoint(_spans(model, rows, "at"))
    cells = _dictionary(model, spans, values, blanks=True).select("rect", F.col("at").alias("pos"), "n", "s")
    many = spans.where("rect IS NOT NULL").select("id", "place", "rect").join(cells, "rect").select("id", "place", "pos", "n", "s")
    one = spans.where("rect IS NULL").select("id", "place", F.lit(1).alias("pos"), F.col("arg_n").alias("n"), F.col("arg_s").alias("s"))
    lists = many.unionByName(one).groupBy("id", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "s"))).alias("v"))
    whole = lists.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.array().cast("array<struct<pos:int,n:double,s:string>>"))
    none = F.lit(None).cast("string").alias("v_str")
    if kind == "CONCATENATE":
        order = F.flatten(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.element_at("m", k)))
        shown = F.transform(order, lambda x: C.text(C.V(x["n"], x["s"], "any")))
        return whole.select("id", F.lit(None).cast("double").alias("v_num"), F.array_join(shown, "").alias("v_str"))
    number = lambda x: F.coalesce(x["n"], x["s"].try_cast("double"), F.lit(0.0))
    flows = F.transform(at(0), number)
    guess = at(1 if kind == "IRR" else 2)
    first = F.when(F.size(guess) > 0, number(F.element_at(guess, 1))).otherwise(0.1)
    if kind == "IRR":
        rate = _irr(flows, first)
    else:
        days = F.transform(at(1), lambda x: F.coalesce(x["n"], L.serial(F.coalesce(L.dated(x["s"]), F.lit(L.NO_DATE).cast("date"))).cast("double")))
        rate = _xirr(flows, days, first)
    return whole.select("id", rate.alias("v_num")).select("id", "v_num", F.when(F.col("v_num").isNull(), F.lit(NUM)).otherwise(none).alias("v_str"))


@F.pandas_udf(DoubleType())
def _irr(flows: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series([L.irr(f.astype(float), g) for f, g in zip(flows, guess, strict=True)], dtype="float64").astype(object).where(lambda x: x.notna(), None)


@F.pandas_udf(DoubleType())
def _xirr(flows: pd.Series, days: pd.Series, guess: pd.Series) -> pd.Series:
    return pd.Series([L.xirr(f.astype(float), d.astype(float), g) for f, d, g in zip(flows, days, guess, strict=True)], dtype="float64").astype(object).where(lambda x: x.notna(), None)


_LOOKUPS = {"COUNTIF": _conditional, "SUMIF": _conditional, "MATCH": _match, "INDEX": _index, "VLOOKUP": _vlookup} | dict.fromkeys(C.LISTS, _in_order)


# Rounds ---------------------------------------------------------------------------------------------------------


def _along_chains(model: _Model, rest: DataFrame, ready: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame | None:
    """id, v_num, v_str of the nodes `ready` and of formulas that hang to one of them, each linear in the one before it; None if too few do.

    Every such formula is a map from the cell before it; each round composes the map with that of the cell it leads to, which doubles
    the way back, and maps that have come to a known cell are applied."""
    open_ = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("tgt").alias("prev")).where("n = 1 AND NOT startswith(prev, 'tile:')")
    shapes = [s for s in model.shapes.get("value", []) if any(C.affine(json.loads(s), k) for k in C.refs_in(json.loads(s)))]
    if not shapes or open_.count() < CHAINED:
        return None
    links = graph.checkpoint(rest.where((F.col("kind") == "value") & F.col("shape").isin(shapes)).join(open_.select(F.col("src").alias("id"), "prev"), "id"))
    one = model.singles.join(links.select(F.col("id").alias("src"), F.col("prev").alias("tgt")), ["src", "tgt"]).groupBy("src").agg(F.min("at").alias("unknown"), F.count(F.lit(1)).alias("n")).where("n = 1")
    rows = _known(model, links.join(one.select(F.col("src").alias("id"), "unknown"), "id"), values)
    maps = graph.checkpoint(_by_shape(rows, shapes, _linear, whole=None).where("a IS NOT NULL AND b IS NOT NULL").select("id", "prev", "a", "b"))
    if maps.join(maps.select(F.col("id").alias("prev")), "prev", "left_semi").count() < CHAINED:
        return None
    base = graph.checkpoint(_step(model, ready, values))
    # Each round doubles the steps, so more rounds than the logarithm of all maps are needed on cycles only, which lead to no known cell.
    for _ in range(maps.count().bit_length() + 1):
        back = maps.select(F.col("id").alias("prev"), F.col("prev").alias("prev2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        joined = maps.join(back, "prev", "left")
        maps = graph.checkpoint(joined.select("id", F.coalesce("prev2", "prev").alias("prev"), (F.col("a") * F.coalesce("a2", F.lit(1.0))).alias("a"), (F.col("a") * F.coalesce("b2", F.lit(0.0)) + F.col("b")).alias("b"), F.col("prev2").isNotNull().alias("moved")))
        if maps.where("moved").isEmpty():
            break
        maps = maps.drop("moved")
    x = F.coalesce("v_num", F.col("v_str").try_cast("double"), F.lit(0.0))
    start = base.select(F.col("id").alias("prev"), x.alias("x"))
    done = maps.join(start, "prev").select("id", (F.col("a") * F.col("x") + F.col("b")).alias("v_num"), F.lit(None).cast("string").alias("v_str"))
    return graph.checkpoint(base.unionByName(done))


def _linear(tree: list) -> dict[str, Column]:
    """Factor `a` and summand `b` of a shape as a function of the reference whose number is in `unknown`, null where they do not exist."""
    ways = {k: C.affine(tree, k) for k in sorted(C.refs_in(tree))}
    pick = lambda c: reduce(lambda w, k: F.when(F.col("unknown") == k, ways[k][c]).otherwise(w), [k for k, w in ways.items() if w], C.no_num())
    return {"a": pick(0), "b": pick(1)}


def _rings(nodes: DataFrame, outer: DataFrame, inner: DataFrame, shapes: list[str]) -> DataFrame | None:
    """id, scc, and what UNROLLED - 1 and UNROLLED sweeps make of a cell: `a` * x + `b` with the value x of `prev`, of the components in which each cell
    names one other cell of it, once, and is linear in it; None if there are none. A sweep is one step of these maps, so sweeps are composed by doubling."""
    # A formula that is nothing but a reference passes texts on; the bounds keep composed factors finite.
    shapes = [s for s in shapes if json.loads(s)[0] != "ref" and any(C.affine(json.loads(s), k) for k in C.refs_in(json.loads(s)))]
    if not shapes:
        return None
    one = inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("unknown"), F.min("tgt").alias("prev")).where("n = 1").drop("n")
    rows = outer.where((F.col("kind") == "value") & (F.size("ranges") == 0) & F.col("shape").isin(shapes)).join(one, "id")
    maps = graph.checkpoint(_by_shape(rows, shapes, _linear, whole=None).where("abs(a) <= 1e20 AND abs(b) <= 1e20").select("id", "scc", "prev", "a", "b"))
    if maps.isEmpty():
        return None
    has = maps.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    whole = nodes.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).join(has, ["scc", "n"]).select("scc")
    first = graph.checkpoint(maps.join(whole, "scc", "left_semi").select("id", "scc", "prev", "a", "b"))

    def after(left: DataFrame, right: DataFrame) -> DataFrame:
        """The steps of `left`, and from where they lead those of `right`."""
        on = right.select(F.col("id").alias("prev"), F.col("prev").alias("prev2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        made = left.join(on, "prev").select("id", "scc", F.col("prev2").alias("prev"), (F.col("a") * F.col("a2")).alias("a"), (F.col("a") * F.col("b2") + F.col("b")).alias("b"))
        return graph.checkpoint(made)

    most, power, left = None, first, UNROLLED - 1
    while left:
        if left % 2:
            most = power if most is None else after(most, power)
        left //= 2
        power = after(power, power) if left else power
    whole = after(first, most).select("id", *(F.col(c).alias(f"{c}_all") for c in ("prev", "a", "b")))
    return graph.checkpoint(most.join(whole, "id"))


def _swept_rings(rings: DataFrame, state: DataFrame) -> DataFrame:
    """id, scc, v_num, v_str, old_num, old_str: values after UNROLLED sweeps, and those before the last one."""
    x = F.coalesce("v_num", F.col("v_str").try_cast("double"), F.lit(0.0))
    before, start = (state.select(F.col("id").alias(c), x.alias(f"x_{c}")) for c in ("prev", "prev_all"))
    joined = rings.join(before, "prev").join(start, "prev_all")
    none = F.lit(None).cast("string")
    return joined.select("id", "scc", (F.col("a_all") * F.col("x_prev_all") + F.col("b_all")).alias("v_num"), none.alias("v_str"), (F.col("a") * F.col("x_prev") + F.col("b")).alias("old_num"), none.alias("old_str"))


def _cycles(model: _Model, todo: DataFrame, values: DataFrame, stored: DataFrame, scc: DataFrame) -> DataFrame:
    """id, v_num, v_str of cells on cycles, all components (id, scc) at once: each sweep computes all cells from the values of the last one,
    and a component is done when none of its values moves. Rings of linear formulas make UNROLLED sweeps at once (`_rings`)."""
    nodes = graph.checkpoint(todo.join(scc.select("id", "scc"), "id"))
    first = nodes.select("id", "scc").join(stored.select("id", "v_num", "v_str"), "id", "left")
    start = F.when(F.col("v_str").isNull(), F.coalesce(F.nanvl("v_num", F.lit(0.0)), F.lit(0.0)))
    state = graph.checkpoint(first.select("id", "scc", start.alias("v_num"), "v_str"))
    ids = nodes.select(F.col("id").alias("src"))
    outer = nodes.join(_env(model, nodes, values).withColumnRenamed("src", "id"), "id", "left")
    outer = graph.checkpoint(outer.withColumn("env", F.coalesce("env", F.create_map().cast(ENV))).withColumn("stats", F.lit(None).cast(STATS)))
    inner = graph.checkpoint(model.singles.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "tgt"), "tgt", "left_semi"))

    out, rings = None, _rings(nodes, outer, inner, model.shapes.get("value", []))
    if rings is not None:
        in_rings = graph.checkpoint(rings.select("scc").distinct())
        out = _until_settled(graph.checkpoint(state.join(in_rings, "scc", "left_semi")), lambda state: _swept_rings(rings, state))
        nodes, outer, state = (graph.checkpoint(t.join(in_rings, "scc", "left_anti")) for t in (nodes, outer, state))
        if nodes.isEmpty():
            return out
    single = nodes.where("kind <> 'value' OR size(ranges) > 0").isEmpty()

    def swept(state: DataFrame) -> DataFrame:
        """The next values. Where nothing but single references is read, only those inside the cycles are looked up again."""
        if not single:
            new = _step(model, nodes, values.unionByName(state.select("id", "v_num", "v_str")))
            return graph.checkpoint(new.join(nodes.select("id", "scc"), "id").select("id", "scc", "v_num", "v_str"))
        entry = F.struct("at", F.struct(F.col("v_num").alias("n"), F.col("v_str").alias("s")))
        mine = inner.join(state.select(F.col("id").alias("tgt"), "v_num", "v_str"), "tgt").groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("own"))
        rows = outer.join(mine, "id").withColumn("env", F.map_concat("env", "own"))
        both = lambda tree: (lambda v: {"v_num": v.num, "v_str": v.txt})(C.value(tree))
        return _by_shape(rows, model.shapes["value"], both).select("id", "scc", "v_num", "v_str")

    def several(state: DataFrame) -> DataFrame:
        for _ in range(UNROLLED):
            before, state = state, swept(state)
        return state.join(before.select("id", F.col("v_num").alias("old_num"), F.col("v_str").alias("old_str")), "id")

    def leave(settled: DataFrame) -> None:
        nonlocal nodes, outer
        nodes, outer = (graph.checkpoint(t.join(settled, "scc", "left_anti")) for t in (nodes, outer))

    rest = _until_settled(state, several, leave)
    return rest if out is None else out.unionByName(rest)


def _until_settled(state: DataFrame, several, leave=lambda settled: None) -> DataFrame:
    """id, v_num, v_str of the cells of `state` (id, scc, v_num, v_str) when their component moves no more, or marked. `several` makes UNROLLED sweeps and gives
    the values before the last one beside those after it; `leave` is told which components have settled."""
    num = lambda n, s: F.coalesce(F.col(n), F.col(s).try_cast("double"), F.lit(0.0))
    out = None
    for _ in range(0, ITERATIONS, UNROLLED):
        moved = F.abs(num("v_num", "v_str") - num("old_num", "old_str"))
        moved = F.when(F.col("v_str").isNotNull() & ~F.col("v_str").eqNullSafe(F.col("old_str")), F.greatest(moved, F.lit(1.0))).otherwise(moved)
        joined = graph.checkpoint(several(state).withColumn("moved", F.coalesce(F.nanvl(moved, F.lit(float("inf"))), F.lit(float("inf")))))
        settled = graph.checkpoint(joined.groupBy("scc").agg(F.max("moved").alias("most")).where(F.col("most") < TOLERANCE).select("scc"))
        state = joined.select("id", "scc", "v_num", "v_str")
        if not settled.isEmpty():
            done = state.join(settled, "scc", "left_semi").select("id", "v_num", "v_str")
            out = done if out is None else out.unionByName(done)
            state = graph.checkpoint(state.join(settled, "scc", "left_anti"))
            if state.isEmpty():
                return out
            leave(settled)
    marked = state.select("id", C.no_num().alias("v_num"), F.lit("#CIRC!").alias("v_str"))
    return marked if out is None else out.unionByName(marked)


def formulas_read(cells: DataFrame) -> DataFrame:
    """The formulas of `cells`, read and written, for what evaluates these cells more than once."""
    return graph.checkpoint(_read(cells))


def formulas_read_of(*tables: DataFrame) -> list[DataFrame]:
    """`formulas_read` of several tables of cells, such as versions of one workbook; texts that they have in common are read once."""
    texts = formula.texts(reduce(DataFrame.unionByName, [t.select("formula_raw") for t in tables]))
    nodes = graph.checkpoint(texts.select("formula_raw", C.nodes("formula_raw").alias("nodes")))
    return [graph.checkpoint(t.join(nodes, "formula_raw").select("id", "sheet", "nodes")) for t in tables]


def evaluate(cells: DataFrame, only: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """id, v_num, v_str of all cells after evaluation. `cells` as `with_ids` gives them; `only` (column id) limits what is
    evaluated, the others keep their stored values. A formula that cannot be read keeps its stored value. `read` has the formulas
    that are evaluated as `formulas_read` gives them, if they have been read before."""
    model, values = nodes_and_values(cells, only, read)
    inner = model.nodes.where("id <> cell").select("id")
    return values if inner.isEmpty() else values.join(graph.checkpoint(inner), "id", "left_anti")


def nodes_and_values(cells: DataFrame, only: DataFrame | None = None, read: DataFrame | None = None) -> tuple[_Model, DataFrame]:
    """The model that `evaluate` makes, and id, v_num, v_str of cells and of what is looked up inside formulas."""
    of = lambda t: t if only is None else t.join(only.select("id"), "id", "left_semi")
    if read is None:
        read = formulas_read(of(cells))
    elif only is not None:
        read = graph.checkpoint(of(read))
    model = _Model(cells, read)
    nodes, values = model.nodes, cells.select("id", "v_num", "v_str").join(model.nodes.select("id"), "id", "left_anti")
    values = graph.checkpoint(values)
    edges = graph.checkpoint(model.edges(nodes))
    loops = edges.where("src = tgt").select(F.col("src").alias("id"), F.col("src").alias("scc"))
    scc, rounds, done = None, 0, None
    while True:
        rest = nodes if done is None else nodes.join(done, "id", "left_anti")
        # Where nothing waits any more, what is left is the last round.
        last = edges.isEmpty()
        ready = graph.checkpoint(rest if last else rest.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        rounds += 1
        if not ready.isEmpty():
            # Deep models are looked through for chains now and then; shallow ones are done before.
            new = _along_chains(model, rest, ready, edges, values) if rounds % LOOKED == 0 and not last else None
            new = graph.checkpoint(_step(model, ready, values)) if new is None else new
            if last:
                return model, values.unionByName(new)
        elif rest.isEmpty():
            return model, values
        else:
            # All that is left lies on cycles or behind them: cycles that wait for nothing else are next.
            if scc is None:
                found = graph.components(edges)
                scc = graph.checkpoint(found.unionByName(loops.join(found, "id", "left_anti")))
            inside = edges.join(scc.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(scc.select(F.col("id").alias("tgt"), F.col("scc").alias("b")), "tgt", "left")
            waiting = inside.where("b IS NULL OR a <> b").select(F.col("a").alias("scc")).distinct()
            free = scc.join(waiting, "scc", "left_anti").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
            new = graph.checkpoint(_cycles(model, rest, values, cells, graph.checkpoint(free)))
        values = values.unionByName(new)
        done = new.select("id") if done is None else done.unionByName(new.select("id"))
        gone = new.select("id")
        left = edges.join(gone.withColumnRenamed("id", "tgt"), "tgt", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "tgt")
        if model.has_ranges:
            # A tile that waits for no cell is known.
            full = left.where("startswith(src, 'tile:')").select(F.col("src").alias("tgt")).distinct()
            open_ = left.where("startswith(tgt, 'tile:')").join(full, "tgt", "left_semi")
            left = left.where("NOT startswith(tgt, 'tile:')").unionByName(open_.select("src", "tgt"))
        edges = graph.checkpoint(left)


def _reached(cells: DataFrame, edits: DataFrame, read: DataFrame) -> DataFrame:
    """id: the cells that depend on the edits, ranges by their tiles."""
    model = _Model(cells, read)
    edges = graph.checkpoint(model.edges(cells.select("id").unionByName(model.nodes.select("id")).distinct()))
    start = edits.select("id")
    return graph.reached(edges, start).join(start, "id", "left_anti").join(cells.select("id"), "id", "left_semi").select("id")


def recalculate(cells: DataFrame, edits: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """id, old_num, old_str, new_num, new_str of the cells that change when `edits` (id, v_num, v_str) are set. Only what depends on
    the edits is evaluated; the edited cells themselves are not listed. Formulas are read once, or not at all if `read` has them."""
    cells = graph.checkpoint(cells)
    read = formulas_read(cells) if read is None else read
    new = edits.select("id", F.col("v_num").cast("double").alias("n"), F.col("v_str").alias("s"), F.lit(True).alias("edited"))
    joined = cells.join(new, "id", "left")
    edited = joined.select(
        "id", *KEY, F.when(F.col("edited"), F.col("n")).otherwise(F.col("v_num")).alias("v_num"), F.when(F.col("edited"), F.col("s")).otherwise(F.col("v_str")).alias("v_str"),
        F.when(F.col("edited").isNull(), F.col("formula_raw")).alias("formula_raw"),
    )
    dirty = graph.checkpoint(_reached(cells, edits, read))
    after = evaluate(edited, dirty, read).join(dirty, "id", "left_semi")
    before = cells.select("id", F.col("v_num").alias("old_num"), F.col("v_str").alias("old_str"))
    both = after.select("id", F.col("v_num").alias("new_num"), F.col("v_str").alias("new_str")).join(before, "id").join(edits.select("id"), "id", "left_anti")
    return both.where(~(F.col("old_num").eqNullSafe(F.col("new_num")) & F.col("old_str").eqNullSafe(F.col("new_str"))))


def reach(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: n_cells, n_affected (cells that depend on the edits), n_unchanged (neither edited nor affected)."""
    affected = _reached(cells, edits, formulas_read(cells)).join(edits.select("id"), "id", "left_anti").select("id", F.lit(1).alias("hit"))
    edited = edits.select("id").distinct().withColumn("set", F.lit(1))
    joined = cells.select("id").join(affected, "id", "left").join(edited, "id", "left")
    n, hit, given = F.count(F.lit(1)), F.count("hit"), F.count("set")
    return joined.agg(n.alias("n_cells"), hit.alias("n_affected"), (n - hit - given).alias("n_unchanged"))
