"""Lookups set-wise: one dictionary for each looked-up range, asked by all formulas at once.

`exact` is a hash join with the dictionary's first place of each key; `last_not_after` is an as-of join: dictionary entries and requests
are sorted in one order by ranges of it, each range is scanned on its own, and what a range ends with is carried
over to the next ones by a small table with one row for each range and dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.graph import checkpoint


def last_not_after(entries: DataFrame, requests: DataFrame, by: list[str], key: str, held: str, best: bool = False, down: bool = False) -> DataFrame:
    """The columns of `requests` with `held` of the last entry whose `key` is not above the request's, among those equal in `by`; null where there is none. With
    `best`, the greatest `held` of all such entries; with `down`, of those whose key is not below. Of entries with one key the greatest `held` counts.
    Null keys find nothing."""
    others = [c for c in requests.columns if c not in (*by, key)]
    e = entries.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.max(held).alias("_held")).select(*by, key, "_held", F.lit(0).alias("_asks"), F.lit(None).alias("_row"))
    asking = requests.select(*by, key, F.lit(1).alias("_asks"), F.struct(*(others or [F.lit(0).alias("_none")])).alias("_row"))
    rows = e.withColumn("_row", F.lit(None).cast(asking.schema["_row"].dataType)).unionByName(asking.withColumn("_held", F.lit(None).cast(e.schema["_held"].dataType)))
    sorted_key = F.col(key).desc_nulls_first() if down else F.col(key).asc_nulls_first()
    order = [*by, sorted_key, "_asks"]
    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *by).orderBy(sorted_key, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.max("_held").over(within) if best else F.last("_held", ignorenulls=True).over(within)
    ends = dealt.groupBy("_range", *by).agg(F.max("_held").alias("_end") if best else (F.min_by if down else F.max_by)("_held", F.when(F.col("_asks") == 0, F.col(key))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", (F.max("_end") if best else F.last("_end", ignorenulls=True)).over(before)).drop("_end")
    found = dealt.withColumn("_found", so_far).where("_asks = 1").join(carried, ["_range", *by])
    value = F.greatest("_found", "_before") if best else F.coalesce("_found", "_before")
    return found.select(*by, key, *(F.col(f"_row.{c}").alias(c) for c in others), F.when(F.col(key).isNotNull(), value).alias(held))


def first_equal(entries: DataFrame, requests: DataFrame, by: list[str], keys: str, held: str) -> DataFrame:
    """The columns of `requests` with the least `held` of the entries that share one of the texts in the array `keys`, among those equal in `by`."""
    named = requests.withColumn("_ask", F.monotonically_increasing_id())
    named = checkpoint(named)
    asked = named.select("_ask", *by, F.explode(keys).alias("_key"))
    first = entries.select(*by, F.explode(keys).alias("_key"), held).groupBy(*by, "_key").agg(F.min(held).alias(held))
    found = asked.join(first, [*by, "_key"]).groupBy("_ask").agg(F.min(held).alias(held))
    return named.join(found, "_ask", "left").drop("_ask")


def _shown(x: Column) -> Column:
    """A number as a key: -0 is 0."""
    return (x + F.lit(0.0)).cast("string")


def keys_of_cell(n: Column, s: Column) -> Column:
    """What a cell of a dictionary is found by: a number or blank by numbers, a text by texts and, where it is a number, by that."""
    as_number = s.try_cast("double")
    num = _shown(F.coalesce(n, as_number, F.lit(0.0)))
    text = F.array(F.concat(F.lit("t:"), F.lower(F.trim(s))))
    text = F.when(as_number.isNotNull(), F.concat(text, F.array(F.concat(F.lit("u:"), num)))).otherwise(text)
    return F.concat(F.array(F.concat(F.lit("n:"), num)), F.when(s.isNull(), F.array(F.concat(F.lit("x:"), num))).otherwise(text))


def keys_of_value(n: Column, s: Column) -> Column:
    """The keys that a sought value is equal to: a number to all numbers, a text to texts and, by its number, to numbers."""
    as_number = s.try_cast("double")
    num = _shown(F.coalesce(n, as_number, F.lit(0.0)))
    number = F.array(F.concat(F.lit("n:"), num))
    text = F.array(F.concat(F.lit("x:"), num), F.when(as_number.isNotNull(), F.concat(F.lit("u:"), num)).otherwise(F.concat(F.lit("t:"), F.lower(F.trim(s)))))
    return F.when(s.isNull(), number).otherwise(text)


def matched(values: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """The columns of `requests` (rect, n, s, ...) with `at`: MATCH in the dictionary `values` (rect, at, n, s; blanks have neither n nor s). `kind` names the
    integer column: 0 the first equal value, 1 the last one not above, -1 the last one not below, wherever they stand. Dictionaries are ordered for the ways
    that some request asks for only."""
    turns = [r[0] for r in requests.select(F.signum(kind).cast("int")).distinct().collect()]
    exact = first_equal(
        values.select("rect", keys_of_cell(F.col("n"), F.col("s")).alias("keys"), "at"),
        requests.where(F.col(kind) == 0).withColumn("keys", keys_of_value(F.col("n"), F.col("s"))), ["rect"], "keys", "at",
    ).drop("keys")
    names = requests.columns
    if not any(turns):
        return exact.select(*names, "at")
    ranked = requests.where(F.col(kind) != 0)
    num = lambda n, s: F.coalesce(n, s.try_cast("double"), F.lit(0.0))
    n, s = F.col("n"), F.col("s")
    # Numbers are compared with everything as numbers; texts with texts as texts, with the rest as numbers.
    sides = [("n", num(n, s), F.lit(True), s.isNull()), ("x", num(n, s), s.isNull(), s.isNotNull())]
    entries = requests_ = None
    for turn in (t for t in (1, -1) if t in turns):
        for side, key, held, asks in sides:
            e = values.where(held).select("rect", F.lit(f"{side}{turn}").alias("side"), (key * turn).alias("k"), "at")
            r = ranked.where((F.signum(kind) == turn) & asks).select("*", F.lit(f"{side}{turn}").alias("side"), (key * turn).alias("k"))
            entries, requests_ = (e, r) if entries is None else (entries.unionByName(e), requests_.unionByName(r))
    by_number = last_not_after(entries, requests_, ["rect", "side"], "k", "at", best=True).drop("side", "k")
    low = F.lower(F.trim(s))
    texts = values.where("s IS NOT NULL").select("rect", low.alias("k"), "at")
    asked = ranked.where("s IS NOT NULL")
    both = by_number
    for turn in (t for t in (1, -1) if t in turns):
        mine = asked.where(F.signum(kind) == turn).withColumn("k", low)
        both = both.unionByName(last_not_after(texts, mine, ["rect"], "k", "at", best=True, down=turn < 0).drop("k"))
    merged = both.groupBy(*names).agg(F.max("at").alias("at"))
    return exact.select(*names, "at").unionByName(merged.select(*names, "at"))
