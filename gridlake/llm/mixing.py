"""Mixing sources to target weights by Pareto order sampling.

A source that should contribute r times its words gives floor(r) certain copies of each document; the rest
is a fixed-size sample in which a document has inclusion probability p (the fraction of its expected copies
that is not certain). Each document gets a uniform number u from a hash; documents are ranked by
odds(u) / odds(p), and the first ones are taken until their words fill what the certain copies leave of the
target. Expected copies follow a document's importance, so p differs between the documents of a source; what
the most important ones cannot take, because no document is taken more than `most` times, the others get.

The rank at which a source is filled is found without sorting it: words are summed in bins of the rank
value, the bin where the running sum passes the aim is split again, digit by digit, until it is small, and only
its few documents are put in order. Documents of one id have one rank value; such ties are split further by
a hash of the row. What the driver holds is one row for each source, so their number must fit it.

Cases: a null text has no words; documents without words are taken as often as the others but add nothing.
Null sources are one source, last in order. Sources without words have target 0. A null or negative importance is 0:
such a document is taken only if the others cannot fill the target. Equal rank values (repeated
rows) are ordered by a hash of the row's place, so repeated rows may differ in copies but their sum is fixed.
An empty table gives an empty one. Further columns of the input are kept by `mix` under any name, but for
size, source_size, target and copies, which its results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import boxed, cut, local_table, unboxed, word_count

#: Bins into which each round splits the rank values of a source; digits of the rank value, and of the row's hash.
BINS, DIGITS, TIE_DIGITS = 256, 5, 4
#: Documents of one source that may be put in order at the end.
ORDERED = 2000
#: A rate at which all that has any importance is taken as often as may be.
EVERY = 1e300
#: No document contributes more than this many times its size, and so no source more than this times its own.
MOST_COPIES = 2.0


def shares(sizes: list[tuple[str | None, int]], weights: list[float], share: float, most: float) -> list[float]:
    """Targets of sources in the given order: `share` of all words, dealt by cycling weights; what lies above
    `most` times a source's size is dealt anew among the others until none is above."""
    total = share * sum(n for _, n in sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(t for k, t in enumerate(targets) if k not in open_)
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > most * sizes[k][1]}
        for k in full or open_:
            targets[k] = most * sizes[k][1] if full else level * weight[k]
        open_ -= full or set(open_)
    return targets


def _digits(value: str, names: list[str]) -> dict[str, Column]:
    """Digits to the base BINS of a number between 0 and 1, one name each."""
    x = F.least(F.floor(F.col(value) * float(BINS ** len(names))), F.lit(BINS ** len(names) - 1))
    return {n: F.pmod(F.floor(x / BINS ** (len(names) - 1 - k)), F.lit(BINS)).cast("int") for k, n in enumerate(names)}


RANKED = [f"d{k}" for k in range(DIGITS)]
LEVELS = RANKED + [f"t{k}" for k in range(TIE_DIGITS)]


def _levels() -> dict[str, Column]:
    return _digits("v", RANKED) | _digits("tie", LEVELS[DIGITS:])


def _find_cuts(ranked: DataFrame, aims: DataFrame) -> dict[str, dict]:
    """Where the sample of a source ends: by source_key the digits of its last bin, as far as they were needed, then v, tie and
    row of the last document in it that is taken (v is -1 if none is). Sources that have too few words have no entry. `ranked`
    has source_key, size, v and tie (between 0 and 1), row; `aims` has source_key, aim (words)."""
    binned = ranked.withColumns(_levels())
    found = aims.withColumn("before", F.lit(0.0))
    keys = ["source_key"]
    for name in LEVELS:
        within = binned if name == LEVELS[0] else binned.join(found, keys, "left_semi")
        sums = within.groupBy(*keys, name).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("source_key").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows
        passed = sums.join(found.drop("rows"), keys).withColumn("upto", F.col("before") + F.sum("words").over(order)).where(F.col("upto") > F.col("aim"))
        first = passed.groupBy(*keys, "aim").agg(F.min_by(F.struct(name, (F.col("upto") - F.col("words")).alias("before"), "rows"), name).alias("b"))
        rows = first.select(*keys, "aim", f"b.{name}", "b.before", "b.rows")
        # One row for each source: as a local table its size is known, so documents need not be dealt by source.
        held = rows.collect()
        found = local_table(rows.sparkSession, held, rows.schema)
        keys = [*keys, name]
        if max((r.rows for r in held), default=0) <= ORDERED:
            break
    order = Window.partitionBy("source_key").orderBy("v", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = binned.join(found, keys).withColumn("upto", F.col("before") + F.sum("size").over(order))
    # Of the two ends around the aim the nearer one: a document that passes it is taken if most of it lies below.
    fits = F.col("upto") - F.col("size") / 2.0 <= F.col("aim")
    none = F.struct(F.lit(-1.0).alias("v"), F.lit(-1.0).alias("tie"), F.lit(-1).cast("long").alias("row"))
    ends = last.groupBy(*keys).agg(F.max(F.when(fits, F.struct("v", "tie", "row")).otherwise(none)).alias("at"))
    unused = [F.lit(-1).alias(n) for n in LEVELS if n not in keys]
    return {r.source_key: r["last"].asDict() for r in ends.select("source_key", F.struct(*keys[1:], *unused, "at.v", "at.tie", "at.row").alias("last")).collect()}


def _rates(slim: DataFrame, sizes: dict[str, int], targets: dict[str, float], most: float) -> dict[str, float]:
    """By source the rate: the number that times importance gives expected copies, so that with none above `most` the words expected are
    the target. Documents at `most` are told from the others anew until they stay the same; each round only adds some."""
    spark, rates, capped = slim.sparkSession, {k: 0.0 for k in targets}, None
    taken_whole = {k for k, n in sizes.items() if targets[k] >= most * n * (1 - 1e-12)}
    while True:
        known = local_table(spark, list(rates.items()), "source_key string, r double")
        above = F.col("r") * F.col("importance") >= most
        sums = slim.join(known, "source_key").groupBy("source_key").agg(
            F.coalesce(F.sum(F.when(above, F.col("size"))), F.lit(0)).alias("full"), F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(~above, F.col("size") * F.col("importance"))), F.lit(0.0)).alias("w"),
        ).collect()  # one row for each source
        now = {r.source_key: r.n for r in sums}
        if now == capped:
            return rates
        for r in sums:
            k = r.source_key
            if k in taken_whole:
                rates[k] = EVERY if sizes[k] else 0.0
            elif r.w > 0:
                rates[k] = max(0.0, targets[k] - most * r.full) / r.w
            elif not r.full:  # words, but no importance
                rates[k] = 0.0
        capped = now


def mix(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    seed: int = 0,
    most: float = MOST_COPIES,
    importance: Column | str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (all, unless named) with size, source_size, target and copies.

    Expected copies of a document are its source's rate times its importance (1 unless a column or expression of `docs` is
    given), at most `most`. Texts are not shuffled: they are read once to be measured and, if kept, once more."""
    spark = docs.sparkSession
    added = ["size", "source_size", "target", "copies"]
    keep = [c for c in keep or docs.columns if c not in added]
    given = F.lit(1.0) if importance is None else docs[importance] if isinstance(importance, str) else importance
    measures = {
        "size": word_count(docs["text"]),
        "source_key": F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("null")),
        "u": F.xxhash64(F.lit(seed), docs["doc_id"]) / F.lit(2.0**64) + 0.5,
        "row": F.monotonically_increasing_id(),  # tells repeated rows apart; the same in each scan of the same files
        "importance": F.greatest(F.coalesce(given.cast("double"), F.lit(0.0)), F.lit(0.0)),
    }
    light = all(c in ("doc_id", "source") for c in keep)
    # What is kept stands in a struct, so that it clashes with no name used here.
    measured = docs.select(boxed(docs, keep).alias("_kept"), *[e.alias(c) for c, e in measures.items()])
    slim = cut(measured if light else measured.drop("_kept"))
    sums = slim.groupBy("source_key").agg(F.sum("size").alias("n")).collect()  # one row for each source
    named = sorted(((r.source_key[1:] if r.source_key[0] == "s" else None, r.n) for r in sums), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    keys = ["null" if name is None else "s" + name for name, _ in named]
    targets = dict(zip(keys, shares(named, weights, share, most), strict=True))
    rates = _rates(slim, dict(zip(keys, (n for _, n in named), strict=True)), targets, most)
    sources = [(k, n, targets[k], rates[k]) for k, (_, n) in zip(keys, named, strict=True)]
    kinds = "source_key string, source_size long, target double, rate double"
    drawn = _drawn(slim, local_table(spark, sources, kinds), most)
    aims = drawn.groupBy("source_key").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("aim"))
    last = _find_cuts(drawn.where("v is not null").select("source_key", "size", "v", "tie", "row"), aims)
    sources = [(*x, last.get(x[0])) for x in sources]
    kinds += ", last struct<" + "".join(f"{n}:int," for n in LEVELS) + "v:double,tie:double,row:long>"
    drawn = _drawn(slim if light else measured, local_table(spark, sources, kinds), most)
    # Before the last bin by its digits, or in it and not after the last document.
    before, inside = F.lit(False), F.lit(True)
    for name, digit in _levels().items():
        unused = F.col(f"last.{name}") < 0
        before = before | (inside & ~unused & (digit < F.col(f"last.{name}")))
        inside = inside & (unused | (digit == F.col(f"last.{name}")))
    inside = inside & (F.struct("v", "tie", "row") <= F.struct(F.col("last.v"), F.col("last.tie"), F.col("last.row")))
    copies = F.col("whole") + F.when(F.col("v").isNotNull() & (F.col("last").isNull() | before | inside), 1).otherwise(0)
    return drawn.select(*unboxed("_kept", keep), "size", "source_size", "target", copies.cast("long").alias("copies"))


def _drawn(rows: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Adds whole (certain copies), v, the Pareto rank value odds(u) / odds(p), brought between 0 and 1, and tie."""
    odds = F.col("u") / (1.0 - F.least("u", F.lit(1 - 1e-15))) * (1.0 - F.col("p")) / F.greatest(F.col("p"), F.lit(1e-300))
    return (
        rows.join(sources, "source_key")
        .withColumn("expected", F.least(F.lit(most), F.col("rate") * F.col("importance")))
        # A hair is added, so that a full 2 stays 2 in floating point.
        .withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("long"))
        .withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("v", F.when(F.col("p") > 1e-9, odds / (1.0 + odds)).when((F.col("importance") == 0) & (F.col("target") > 0), 1.0))
        .withColumn("tie", F.xxhash64("row") / F.lit(2.0**64) + 0.5)
    )
