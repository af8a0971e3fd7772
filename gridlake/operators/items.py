"""Labelled line items: column profiles, noise names, items of parameter, table and series sheets.

Input is the cell table: sheet, row, col_ix, v_num, v_str, formula_raw. An item is one row of a sheet with a
name, perhaps a value cell, a unit and a span of columns that form a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.evaluate import cell_id

# Patterns of names that are no items, and words that mark totals and headers.
NOISE = [
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"^\d{4}$",
    r"^[A-Z]{1,3}$",
    r"^[+-]?[\d,]+\.?\d*$",
    r"\d{4}年\d{1,2}月.*自动取时点",
    r".+第\d+[年期间次月]+",
]
TOTALS = ["合计", "总计", "小计", "一、", "二、", "三、", "四、", "五、", "六、", "七、", "八、", "九、", "十、"]
PARAMETER_NAMES, SERIES_NAMES = ("参数输入", "param"), ("时间序列", "time")
SHORTEST = 3
# Texts of the third row that head a parameter sheet, the mark of tables, and names that head columns of parameters.
HEADED_BY, TABLE_NAME = ("参数", "类别"), "表"
NO_PARAMETERS = [
    "项目", "单位", "合计", "总计", "小计", "参数", "操作类型", "类别", "序号", "取值说明", "备注", "数据结构化整理",
    "收入/成本归类", "参数释义/计算公式", "数据来源", "填写说明", "参数名称", "参数值",
]


def is_noise(name: Column) -> Column:
    found = F.length(F.trim(name)) < SHORTEST
    for pattern in NOISE:
        found = found | F.trim(name).rlike(pattern)
    return F.coalesce(found, F.lit(True))


def profile(cells: DataFrame) -> DataFrame:
    """sheet, col_ix, n_formula, n_number, n_text, n_total: what the columns hold."""
    formula, number = F.col("formula_raw").isNotNull(), F.col("v_num").isNotNull()
    return cells.groupBy("sheet", "col_ix").agg(
        F.count_if(formula).alias("n_formula"), F.count_if(~formula & number).alias("n_number"),
        F.count_if(~formula & ~number & F.col("v_str").isNotNull()).alias("n_text"), F.count(F.lit(1)).alias("n_total"),
    )


def sheet_kind(name: Column, headed: Column | None = None) -> Column:
    """parameter, series or table, by the sheet's name; `headed` (whether its third row has a parameter header) tells where the
    name does not."""
    low = F.lower(name)
    return (
        F.when(name.contains(PARAMETER_NAMES[0]) | low.contains(PARAMETER_NAMES[1]), "parameter")
        .when(name.contains(SERIES_NAMES[0]) | low.contains(SERIES_NAMES[1]), "series")
        .when(name.contains(TABLE_NAME) | ~F.coalesce(headed if headed is not None else F.lit(False), F.lit(False)), "table")
        .otherwise("parameter")
    )


def kinds(cells: DataFrame) -> DataFrame:
    """sheet, kind: a row for each sheet."""
    header = (F.col("row") == 3) & F.col("v_str").isin(*HEADED_BY)
    return cells.groupBy("sheet").agg(F.max(F.coalesce(header, F.lit(False))).alias("headed")).select("sheet", sheet_kind(F.col("sheet"), F.col("headed")).alias("kind"))


def carried(cells: DataFrame, section: Column, order: str, *by: str) -> Column:
    """The last section marker at or above a row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(section, ignorenulls=True).over(w)


def _rows(cells: DataFrame) -> DataFrame:
    """sheet, row, cells: the row's cells in column order; a row of a sheet is bounded by its width."""
    cell = F.struct("col_ix", "v_num", "v_str", "formula_raw")
    return cells.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _texts(cells: Column) -> Column:
    return F.filter(cells, lambda c: c["formula_raw"].isNull() & c["v_num"].isNull() & c["v_str"].isNotNull())


def _values(cells: Column) -> Column:
    return F.filter(cells, lambda c: c["formula_raw"].isNotNull() | c["v_num"].isNotNull())


def _linked(name_col: Column, value_col: Column) -> list[Column]:
    """name_col, name_cell, value_cell, cell_ids: which cells make an item, by `cell_id`."""
    whole = lambda k: F.when(k.isNotNull(), cell_id("sheet", "row", k))
    ids = F.transform("cells", lambda c: cell_id("sheet", "row", c["col_ix"]))
    return [name_col.alias("name_col"), whole(name_col).alias("name_cell"), whole(value_col).alias("value_cell"), ids.alias("cell_ids"), F.col("kind")]


def at(cells: Column, col: int) -> Column:
    return F.try_element_at(F.filter(cells, lambda c: c["col_ix"] == col), F.lit(1))


def table_items(cells: DataFrame) -> DataFrame:
    """Items of table and series sheets. The name stands in column C, in B where C has no text; the leftmost
    formula or number is the value; the last short text is the unit. A series spans the formulas from the
    second on, or the numbers of rows with at most one formula and more than two (without: three) numbers."""
    rows = _rows(cells).join(kinds(cells), "sheet").where("kind <> 'parameter'")
    c, b = (F.when(at(F.col("cells"), k)["v_num"].isNull() & at(F.col("cells"), k)["formula_raw"].isNull(), at(F.col("cells"), k)["v_str"]) for k in (3, 2))
    series = F.col("kind") == "series"
    name = F.when(series, F.coalesce(b, c)).otherwise(F.coalesce(c, b))
    name_col = F.when(series, F.when(b.isNotNull(), 2).otherwise(3)).otherwise(F.when(c.isNotNull(), 3).otherwise(2))
    rows = rows.withColumns({"name": F.trim(name), "name_at": name_col}).where(~is_noise(F.col("name")))
    for word in TOTALS:
        rows = rows.where(series | ~F.col("name").contains(word))
    outside = lambda x: ~x["col_ix"].isin(2, 3)
    rows = rows.select("*", F.when(series, F.filter(_values(F.col("cells")), outside)).otherwise(_values(F.col("cells"))).alias("values"))
    rows = rows.where(F.size("values") > 0)
    formulas = F.filter("values", lambda x: x["formula_raw"].isNotNull())
    numbers = F.filter("values", lambda x: x["formula_raw"].isNull())
    nf, nn = F.size(formulas), F.size(numbers)
    col = lambda xs, k: F.try_element_at(xs, F.lit(k))["col_ix"]
    by_formula, by_number = ~series & (nf >= 2), ~series & (((nf == 1) & (nn > 2)) | ((nf == 0) & (nn > 3)))
    start = F.when(series, col(F.col("values"), 1)).when(by_formula, col(formulas, 2)).when(by_number, col(numbers, 1))
    end = F.when(series, col(F.col("values"), -1)).when(by_formula, col(formulas, -1)).when(by_number, col(numbers, -1))
    short = F.filter(_texts(F.col("cells")), lambda x: (F.length(x["v_str"]) <= 4) & (x["v_str"] != F.col("name")))
    return rows.select(
        F.concat_ws("_", F.lit("BI"), "sheet", "row").alias("item_id"), "sheet", "row", "name", F.try_element_at(short, F.lit(-1))["v_str"].alias("unit"),
        col(F.col("values"), 1).alias("value_col"), start.alias("ts_start"), end.alias("ts_end"), start.isNotNull().alias("has_time_series"),
        F.try_element_at(formulas, F.lit(1))["formula_raw"].alias("formula_source"), F.lit(None).cast("string").alias("section"),
        *_linked(F.col("name_at"), col(F.col("values"), 1)),
    )


def parameter_items(cells: DataFrame) -> DataFrame:
    """Items of parameter sheets: name in D, value in I, unit in J, below the header; a text in B on a row without
    values (but in D and J) opens a section. Sections are carried down by one task for each sheet, of which a workbook allows a million rows."""
    rows = _rows(cells).join(kinds(cells), "sheet").where("kind = 'parameter'")
    text = lambda k: F.try_element_at(F.filter(_texts(F.col("cells")), lambda c: c["col_ix"] == k), F.lit(1))["v_str"]
    unit = at(F.col("cells"), 10)
    rows = rows.select(
        "sheet", "row", "cells", "kind", F.trim(text(2)).alias("b"), F.trim(text(4)).alias("name"), F.coalesce(unit["v_str"], unit["v_num"].cast("string")).alias("unit"), at(F.col("cells"), 9).alias("value"),
    )
    opens = F.col("b").isNotNull() & ~F.exists(_values(F.col("cells")), lambda c: ~c["col_ix"].isin(2, 4, 10))
    header = rows.groupBy("sheet").agg(F.coalesce(F.min(F.when(F.col("name") == "参数", F.col("row"))), F.lit(1)).alias("header"))
    rows = rows.join(header, "sheet").where(F.col("row") > F.col("header"))
    rows = rows.withColumn("section", carried(rows, F.when(opens, F.col("b")), "row", "sheet")).where(~opens)
    has_value = F.col("value.v_num").isNotNull() | F.col("value.formula_raw").isNotNull()
    rows = rows.where(has_value & F.col("name").isNotNull() & ~F.col("name").isin(NO_PARAMETERS) & ~is_noise(F.col("name")))
    none = F.lit(None).cast("int")
    return rows.select(
        F.concat_ws("_", F.lit("BI"), "sheet", "row").alias("item_id"), "sheet", "row", "name", "unit", F.lit(9).alias("value_col"),
        none.alias("ts_start"), none.alias("ts_end"), F.lit(False).alias("has_time_series"), F.col("value.formula_raw").alias("formula_source"), "section",
        *_linked(F.lit(4), F.lit(9)),
    )


def items(cells: DataFrame) -> DataFrame:
    return parameter_items(cells).unionByName(table_items(cells))


def item_edges(found: DataFrame) -> DataFrame:
    """source, target, relation, fragment, role, period: what ties cells to the items `found`. Names and values of parameter and table
    items BELONG_TO them, named cells are PART_OF_SECTION, and cells of a span are TIME_SERIES_OF their item, the period being
    the column's number."""
    empty = F.lit("")
    pair = lambda source, role: F.struct(source.alias("source"), F.lit(role).alias("role"))
    ends = F.explode(F.array(pair(F.col("name_cell"), "name"), pair(F.col("value_cell"), "value"))).alias("x")
    belong = found.where("kind <> 'series'").select("item_id", ends).where("x.source IS NOT NULL")
    belong = belong.select("x.source", F.col("item_id").alias("target"), F.lit("BELONGS_TO").alias("relation"), empty.alias("fragment"), "x.role", empty.alias("period"))
    part = found.where("section IS NOT NULL").select(
        F.col("name_cell").alias("source"), F.concat(F.lit("SECTION_"), "section").alias("target"), F.lit("PART_OF_SECTION").alias("relation"), empty.alias("fragment"), empty.alias("role"), empty.alias("period")
    )
    spans = found.where("has_time_series").select("item_id", F.explode("cell_ids").alias("source"), "ts_start", "ts_end")
    at_col = F.element_at(F.split("source", "!"), -1).cast("int")
    spans = spans.withColumn("k", at_col).where("k BETWEEN ts_start AND ts_end")
    over = spans.select("source", F.col("item_id").alias("target"), F.lit("TIME_SERIES_OF").alias("relation"), empty.alias("fragment"), empty.alias("role"), F.col("k").cast("string").alias("period"))
    return belong.unionByName(part).unionByName(over)


def valued(found: DataFrame, values: DataFrame) -> DataFrame:
    """item_id, name, sheet, row, unit, section, value: items with the number of their value cell (id, v_num), null where it has none."""
    numbers = values.select(F.col("id").alias("value_cell"), F.col("v_num").alias("value"))
    return found.join(numbers, "value_cell", "left").select("item_id", "name", "sheet", "row", "unit", "section", "value")


def series(found: DataFrame, cells: DataFrame) -> DataFrame:
    """item_id, pos, col_ix, v_num: the numbers in each item's span, in order."""
    spans = found.where("has_time_series").select("item_id", "sheet", "row", "ts_start", "ts_end")
    inside = spans.join(cells, ["sheet", "row"]).where((F.col("col_ix") >= F.col("ts_start")) & (F.col("col_ix") <= F.col("ts_end")) & F.col("v_num").isNotNull())
    w = Window.partitionBy("item_id").orderBy("col_ix")
    return inside.select("item_id", F.row_number().over(w).alias("pos"), "col_ix", "v_num")


def generic_items(cells: DataFrame) -> DataFrame:
    """Rows with a text and a value, for sheets of no known kind: the first text is the name; more than three values are a series."""
    rows = _rows(cells).select("sheet", "row", _texts(F.col("cells")).alias("texts"), _values(F.col("cells")).alias("values"))
    rows = rows.where((F.size("texts") > 0) & (F.size("values") > 0)).withColumn("name", F.trim(F.try_element_at("texts", F.lit(1))["v_str"]))
    rows = rows.where(~is_noise(F.col("name")))
    many = F.size("values") > 3
    first, last = (F.try_element_at("values", F.lit(k))["col_ix"] for k in (1, -1))
    return rows.select(
        F.concat_ws("_", F.lit("BI"), "sheet", "row").alias("item_id"), "sheet", "row", "name", F.lit(None).cast("string").alias("unit"), first.alias("value_col"),
        F.when(many, first).alias("ts_start"), F.when(many, last).alias("ts_end"), many.alias("has_time_series"),
        F.try_element_at(F.filter("values", lambda v: v["formula_raw"].isNotNull()), F.lit(1))["formula_raw"].alias("formula_source"), F.lit(None).cast("string").alias("section"),
    )


#: Texts of at most three characters that head columns; fixed values.
HEADERS = ["序号", "名称", "单位", "合计", "数值", "参数", "类别", "备注"]


def is_item_row(texts: Column, n_values: Column) -> Column:
    """Whether a row looks like an item: it has a value and a text that is no column header."""
    return (n_values > 0) & F.exists(texts, lambda t: ~((F.length(t) <= 3) & t.isin(HEADERS)))
