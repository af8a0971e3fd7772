"""Questions about items: what is asked, which item is meant.

Patterns are regular expressions over the question column; names are matched exactly, then through a similarity
ratio. Questions meet only the names with which they share one of their rarest characters, as many as it takes to
miss none that is alike enough.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridlake.operators import evaluate

# Question forms and other names of common items.
ASKS_VALUE = r"^(.+?)(?:是多少|为多少|多少钱|有多少|等于多少|的值|的数值)[？?]?$"
WHAT_IF = r"如果(.+?)(变成|变为|改为|增加|减少)([\d.]+)(%?)[，,](.*)$"
COMPARE = r"^(.+?)(?:和|与)(.+?)(?:的)?(?:对比|区别|比较|差异)"
YEAR, QUARTER = r"(\d{4})[年度]", r"([1-4一二三四])季"
ALIASES = {
    "总投资": ["总投资", "投资"],
    "动态投资": ["动态总投资", "动态投"],
    "静态投资": ["静态总投资", "静态投"],
    "营业收入": ["营业收入", "营收入", "收入"],
    "营业成本": ["营业成本", "营成本", "成本"],
    "净利润": ["净利润", "净利", "利润"],
    "所得税": ["所得税", "税费", "税"],
    "建设期": ["建设期"],
    "运营期": ["运营期", "经营期"],
    "资本金": ["资本金", "资本"],
    "贷款": ["贷款", "借款", "融资"],
    "现金流": ["现金流", "现金"],
    "资产负债": ["资产负债", "资产", "负债"],
    "还本付息": ["还本付息", "还本", "付息"],
}
KEYWORD_SPLIT = r"[、，,·\s]+"


def keywords(name: Column) -> Column:
    plain = F.regexp_replace(name, r"[()（）\[\]【】]", " ")
    return F.filter(F.split(plain, KEYWORD_SPLIT), lambda w: F.length(w) > 1)


def intent(question: Column) -> Column:
    """kind (what_if, compare, value, other), entity, other, action, amount, percent (whether the amount is one), year, quarter (1 to 4), period (like 2025
    or 2025Q3)."""
    q = F.trim(question)
    some = lambda pattern, k: F.nullif(F.regexp_extract(q, pattern, k), F.lit(""))
    year = F.nullif(F.regexp_extract(q, YEAR, 1), F.lit("")).try_cast("int")
    kind = F.when(some(WHAT_IF, 1).isNotNull(), "what_if").when(some(COMPARE, 1).isNotNull(), "compare").when(some(ASKS_VALUE, 1).isNotNull(), "value").otherwise("other")
    entity = F.coalesce(some(WHAT_IF, 1), some(COMPARE, 1), some(ASKS_VALUE, 1), q)
    # The period is asked for beside the entity, and is no part of its name.
    entity = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, YEAR, ""), rf"第?{QUARTER}度?的?", ""), r"的$", ""))
    quarter = F.translate(some(QUARTER, 1), "一二三四", "1234")
    period = F.when(year.isNotNull(), F.concat(year.cast("string"), F.coalesce(F.concat(F.lit("Q"), quarter), F.lit(""))))
    return F.struct(
        kind.alias("kind"), entity.alias("entity"), F.when(kind == "compare", some(COMPARE, 2)).alias("other"), some(WHAT_IF, 2).alias("action"),
        some(WHAT_IF, 3).try_cast("double").alias("amount"), F.coalesce(some(WHAT_IF, 4) == "%", F.lit(False)).alias("percent"), year.alias("year"), quarter.alias("quarter"), period.alias("period"),
    )


def changed(old: Column, action: Column, amount: Column, percent: Column) -> Column:
    """The value after a what-if: set, or raised or lowered by the amount. A percentage raises or lowers by that share of the
    old value; set, it is the number itself."""
    step = F.when(percent, F.abs(old) * amount / 100).otherwise(amount)
    return F.when(action == "增加", old + step).when(action == "减少", old - step).otherwise(F.when(percent, amount / 100).otherwise(amount))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def letters(name: Column) -> Column:
    """Characters of a name, each with how many of it stand before."""

    def labelled(k: Column) -> Column:
        c, before = F.substring(name, k, F.lit(1)), F.substring(name, F.lit(1), k - 1)
        return F.struct(c.alias("c"), (F.length(before) - F.length(F.replace(before, c, F.lit("")))).alias("k"))

    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), labelled))


def rarest(names: DataFrame, key: str, counts: DataFrame, least: float) -> DataFrame:
    """`key` and letter: as many of a name's rarest letters as any name more than `least` alike must meet one of. Names alike share more
    than least * n / (2 - least) letters, n being the length of either, for the other has at least as many as they share."""
    n = F.length(key)
    rows = names.select(key, n.alias("n"), F.explode(letters(F.col(key))).alias("letter")).join(counts, "letter", "left")
    w = Window.partitionBy(key).orderBy(F.coalesce("names", F.lit(0)), "letter")
    return rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.floor(F.col("n") * (least / (2 - least)) - 1e-9)).select(key, "letter")


def fuzzy(questions: DataFrame, names: DataFrame, least: float = 0.4) -> DataFrame:
    """entity, name, likeness: the best name for each distinct entity, the first by name of equals, if more than `least` alike.
    Containment counts as the ratio of lengths where that is more. No name that alike is missed."""
    asked, known = questions.select("entity").distinct(), names.select("name").distinct()
    counts = known.select(F.explode(letters(F.col("name"))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("names"))
    pairs = rarest(asked, "entity", counts, least).join(rarest(known, "name", counts, least), "letter").select("entity", "name").distinct()
    inside = F.col("name").contains(F.col("entity")) | F.col("entity").contains(F.col("name"))
    lengths = F.least(F.length("name"), F.length("entity")) / F.greatest(F.length("name"), F.length("entity"))
    scored = pairs.withColumn("likeness", F.greatest(ratio("entity", "name"), F.when(inside, lengths).otherwise(0.0)))
    w = Window.partitionBy("entity").orderBy(F.desc("likeness"), "name")
    return scored.where(F.col("likeness") > least).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def named(entities: DataFrame, names: DataFrame, least: float = 0.35) -> DataFrame:
    """entity, name: the item of that very name, otherwise the most alike, otherwise an alias's, otherwise none. Names are compared only where
    there is an entity without an item of its name."""
    alias = F.create_map(*[F.lit(x) for canonical, others in ALIASES.items() for o in others for x in (o, canonical)])
    asked = entities.select("entity").distinct()
    exact = asked.join(names.select(F.col("name").alias("entity")).distinct(), "entity", "left_semi").withColumn("name", F.col("entity"))
    rest = evaluate.graph.checkpoint(asked.join(exact, "entity", "left_anti"))
    if rest.isEmpty():
        return exact
    close = fuzzy(rest, names, least).select("entity", "name")
    other = rest.join(close, "entity", "left_anti").withColumn("name", F.try_element_at(alias, F.col("entity")))
    other = other.join(names.select("name").distinct(), "name", "left_semi").select("entity", "name")
    return exact.unionByName(close).unionByName(other)


def answers(questions: DataFrame, values: DataFrame) -> DataFrame:
    """id, kind, name, value, other_name, other_value, difference, percent for questions (id, question) on items' values (name, ord, value).
    Of items with one name the last one counts. A question whose item is not found has no value."""
    asked = questions.select("id", intent(F.col("question")).alias("i")).select("id", "i.kind", "i.entity", "i.other")
    last = values.groupBy("name").agg(F.max_by("value", "ord").alias("value"))
    wanted = asked.select("entity").unionByName(asked.where("other IS NOT NULL").select(F.col("other").alias("entity")))
    found = named(wanted, last).join(last, "name")
    one = found.select("entity", "name", "value")
    two = found.select(F.col("entity").alias("other"), F.col("name").alias("other_name"), F.col("value").alias("other_value"))
    rows = asked.join(one, "entity", "left").join(two, "other", "left")
    d = F.col("value") - F.col("other_value")
    percent = F.when(F.col("other_value") != 0, d / F.abs("other_value") * 100).when(F.col("other_value") == 0, 0.0)
    return rows.select("id", "kind", "name", "value", "other_name", "other_value", d.alias("difference"), percent.alias("percent"))


def series_answers(questions: DataFrame, found: DataFrame, cells: DataFrame) -> DataFrame:
    """id, name, year, col_ix, value for questions (id, question) that name a year: the numbers in the item's span under the columns
    whose heading, in a row above, has that year; the whole span where no heading does. Of items with one name the last counts."""
    asked = questions.select("id", intent(F.col("question")).alias("i")).where("i.year IS NOT NULL").select("id", "i.entity", "i.year")
    spans = found.where("has_time_series").groupBy("name").agg(F.max_by(F.struct("sheet", "row", "ts_start", "ts_end"), F.struct("sheet", "row")).alias("s"))
    spans = evaluate.graph.checkpoint(spans.select("name", "s.*"))
    wanted = asked.join(named(asked, spans), "entity").join(spans, "name").select("id", "name", "year", "sheet", "row", "ts_start", "ts_end")
    inside = F.col("col_ix").between(F.col("ts_start"), F.col("ts_end"))
    heads = cells.where("formula_raw IS NULL").select("sheet", F.col("row").alias("head_row"), "col_ix", F.regexp_extract(F.coalesce("v_str", F.col("v_num").cast("bigint").cast("string")), r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1).alias("head"))
    years = wanted.join(heads.where("head <> ''"), "sheet").where((F.col("head_row") < F.col("row")) & inside & (F.col("head") == F.col("year").cast("string"))).select("id", "col_ix").distinct()
    values = wanted.join(cells.select("sheet", "row", "col_ix", F.col("v_num").alias("value")), ["sheet", "row"]).where(inside & F.col("value").isNotNull())
    dated = years.select("id").distinct().withColumn("dated", F.lit(True))
    picked = values.join(dated, "id", "left").join(years.withColumn("here", F.lit(True)), ["id", "col_ix"], "left")
    return picked.where("dated IS NULL OR here").select("id", "name", "year", "col_ix", "value")


def what_if(question: str, found: DataFrame, cells: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """item, id, old_num, old_str, new_num, new_str: the cells that change when the question comes true. The model's cells hold their
    values; a question that is no what-if, or whose item is not found or has no value cell, changes nothing. `read` as for `evaluate.recalculate`."""
    asked = cells.sparkSession.createDataFrame([(question,)], "question string").select(intent(F.col("question")).alias("i")).select("i.*").where("kind = 'what_if' AND amount IS NOT NULL")
    last = evaluate.graph.checkpoint(found.where("value_cell IS NOT NULL").groupBy("name").agg(F.max_by("value_cell", F.struct("sheet", "row")).alias("id")))
    meant = asked.join(named(asked, last), "entity").join(last, "name").join(cells.select("id", "v_num"), "id")
    new = changed(F.coalesce("v_num", F.lit(0.0)), F.col("action"), F.col("amount"), F.col("percent"))
    edits = evaluate.graph.checkpoint(meant.select("name", "id", new.alias("v_num"), F.lit(None).cast("string").alias("v_str")))
    return evaluate.recalculate(cells, edits.drop("name"), read).join(edits.select(F.col("name").alias("item")), how="cross")  # one row
