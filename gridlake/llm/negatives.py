"""Hard negatives from blocks of vectors that zone maps choose.

Vectors are whole numbers (components times SCALE, rounded down) and a score is their inner product. All vectors are put
in order along a Hilbert curve through their leading principal axes and written as Parquet blocks, each with the least and
greatest whole number of every dimension. Anchors are put into groups in the same order. What an anchor looks for is
a window of scores among the vectors with its label, or among those with other labels. From the anchor and a zone map, interval arithmetic
gives the least and greatest score that any vector of the block can have; a block is read for an anchor only if these bounds meet one of its windows.

Each search has two steps. First an anchor reads its own block, where vectors close to it are; the
`top`-th best score found there raises the lower end of its window. Then the blocks whose bounds meet the window are read, all of them,
and their best are merged. The first search is for positives (any score, the same label); each positive then gives a window for the
second, for negatives (other labels). So no vector that belongs into a result can be missed, however little the zone maps tell
apart; where they tell nothing apart, every anchor reads every block.

Cases: rows with a null id, label or vector, or with null or non-finite components, take no part. Shorter vectors
are filled up with zeros. An id names a vector: repeated rows count once, and of different rows with one id the one of the least label
and vector counts. Ties of scores go to the smaller id. Anchors without positives, and positives without negatives, give no rows. Whole
numbers beyond LARGEST count as that. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm import blocks
from gridlake.llm.common import cut, discard

SCALE, LARGEST = 256, 1 << 26
#: How many positives an anchor has and how many negatives a positive; the share of a positive's score, in percent, that its negatives reach.
TOP, SHARE = 5, 80
#: Vectors of a block, anchors of a group, zone maps that are looked at together.
BLOCK, GROUP, ATLAS = 4096, 256, 1024
#: Beyond any score.
NONE, ALL = -(1 << 62), 1 << 62

FOUND = "anchor long, window int, score long, id long"


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs, exact: in double precision where no sum can exceed its digits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype("i8") if most < 2**53 else a.astype("i8") @ b.astype("i8").T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row of `a` with any whole vector between `lo` and `hi`, row by row."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return scores(up, lo) + scores(down, hi), scores(up, hi) + scores(down, lo)


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in names]


def _needed(groups: DataFrame, atlas: DataFrame, width: int) -> DataFrame:
    """grp, block, who: for each group of anchors and block the places of the anchors of which a window meets the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flat, low, high, who, ids, lo, hi = _lists(batch, row, "flat", "low", "high", "who", "blocks", "los", "his")
                a = whole(flat.reshape(-1, width))
                least, most = bounds(a[who], lo.reshape(-1, width), hi.reshape(-1, width))
                meets = (most >= low[:, None]) & (least <= high[:, None])
                out = [(ids[k], np.unique(who[meets[:, k]])) for k in np.flatnonzero(meets.any(axis=0))]
                grp = pa.array([batch.column("grp")[row].as_py()] * len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([grp, pa.array([b for b, _ in out], pa.int64()), pa.array([w for _, w in out], pa.list_(pa.int32()))], names=["grp", "block", "who"])

    pages = atlas.agg(F.max("page")).first()[0]
    asked = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages))))
    return blocks.small_batches(asked.join(atlas, "page")).mapInArrow(run, "grp long, block long, who array<int>")


def _best(read: DataFrame, width: int, same: bool, top: int) -> DataFrame:
    """anchor, window, score, id: of each row (a group with its windows, a block, and which anchors read it) the best of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flat, anchor, label, who, window, low, high = _lists(batch, row, "flat", "anchor", "anchor_label", "who", "window", "low", "high")
                ids, labels, vectors, readers = _lists(batch, row, "id", "label", "vectors", "readers")
                here = np.isin(who, readers)
                who, window, low, high = (x[here] for x in (who, window, low, high))
                each, at = np.unique(who, return_inverse=True)
                found = scores(whole(flat.reshape(-1, width)[each]), whole(vectors.reshape(-1, width)))
                fits = (labels == label[each][:, None]) == same
                fits &= ids != anchor[each][:, None]
                out: list[list] = [[], [], [], []]
                for k in range(len(who)):
                    s = found[at[k]]
                    c = np.flatnonzero(fits[at[k]] & (s >= low[k]) & (s <= high[k]))
                    if len(c) > 4 * top:
                        c = c[s[c] >= np.partition(s[c], -top)[-top]]
                    c = c[np.lexsort((ids[c], -s[c]))[:top]]
                    for column, x in zip(out, (np.full(len(c), anchor[who[k]]), np.full(len(c), window[k]), s[c], ids[c]), strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                arrays = [pa.array(np.concatenate([np.zeros(0, "i8"), *x]), pa.int64()).cast(t) for x, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "window", "score", "id"])

    return blocks.small_batches(read).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(groups: DataFrame, packs: DataFrame, atlas: DataFrame, windows: DataFrame, width: int, same: bool, top: int) -> DataFrame:
    """anchor, window, score, id, rank: the best `top` of each window (grp, who, anchor, window, own, low, high), written. `own` is the anchor's block."""
    vectors = packs.select("block", "id", "label", F.col("flat").alias("vectors"))

    def read(asked: DataFrame, windows: DataFrame) -> DataFrame:
        """`asked`: grp, block, readers."""
        lists = _listed(windows)
        return _ranked(_best(asked.join(groups, "grp").join(lists, "grp").join(vectors, "block"), width, same, top), top)

    near = windows.groupBy("grp", F.col("own").alias("block")).agg(F.collect_set("who").alias("readers"))
    first = cut(read(near, windows))
    least = first.where(F.col("rank") == top).select("anchor", "window", F.col("score").alias("enough"))
    rest = cut(windows.join(least, ["anchor", "window"], "left").withColumn("low", F.greatest("low", F.coalesce("enough", "low"))).drop("enough"))
    asked = cut(_needed(groups.join(_listed(rest), "grp"), atlas, width).withColumnRenamed("who", "readers"))
    out = cut(read(asked, rest))
    discard(first, rest, asked)
    return out


def _listed(windows: DataFrame) -> DataFrame:
    """The windows of a group side by side; a group holds GROUP anchors at most, and an anchor `top` windows."""
    rows = F.array_sort(F.collect_list(F.struct("who", "window", "low", "high"))).alias("w")
    return windows.groupBy("grp").agg(rows).select("grp", *(F.col(f"w.{c}").alias(c) for c in ("who", "window", "low", "high")))


def mine(rows: DataFrame, is_anchor: Column, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows for which `is_anchor` holds, a
    condition on the column id) and each of its `top` best vectors of the same label, the `top` best vectors of other labels among those that
    score SHARE percent of the positive's score or more, and not more than it."""
    label = F.col(label) if isinstance(label, str) else label
    vec = F.transform(rows[vec_col], lambda x: x.cast("double"))
    given = rows.select(rows[id_col].cast("long").alias("id"), label.cast("int").alias("label"), vec.alias("vec"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & blocks.usable(F.col("vec")))
    once = cut(given.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec"))
    width = blocks.width_of(once)
    if not width:
        return once.limit(0).select(*(F.lit(0).cast(t).alias(c) for c, t in RESULT))
    places = blocks.ordered(once, blocks.principal_axes(once, width), "id")
    packs = cut(blocks.packed(places, "place", {"id": "long", "label": "int"}, BLOCK, width, whole))
    atlas = _atlas(packs)
    # Anchors of a group follow each other on the curve; their numbers are places among all vectors, of which about the same share is anchors.
    anchors = places.where(is_anchor)
    anchors = cut(blocks.ordered(anchors.select("id", "label", F.floor(F.col("place") / BLOCK).alias("own"), "vec"), blocks.principal_axes(once, width), "id"))
    packed = blocks.packed(anchors, "place", {"id": "long", "label": "int"}, GROUP, width, whole)
    groups = cut(packed.select(F.col("block").alias("grp"), F.col("id").alias("anchor"), F.col("label").alias("anchor_label"), "flat"))
    number = F.col("place")
    asked = anchors.select(F.floor(number / GROUP).alias("grp"), (number % GROUP).cast("int").alias("who"), F.col("id").alias("anchor"), "own")
    any_score = (F.lit(x).cast("long").alias(c) for c, x in (("low", NONE), ("high", ALL)))
    positives = _search(groups, packs, atlas, cut(asked.withColumn("window", F.lit(0)).select("*", *any_score)), width, True, top)
    p = positives.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 * negative >= SHARE * positive, in whole numbers.
    low = -F.floor(-F.col("positive_score") * SHARE / F.lit(100).cast("decimal(20,0)"))
    windows = cut(asked.join(p, "anchor").select("grp", "who", "anchor", "own", "window", low.cast("long").alias("low"), F.col("positive_score").alias("high")))
    found = _search(groups, packs, atlas, windows, width, False, top)
    out = found.join(p, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _atlas(packs: DataFrame) -> DataFrame:
    """page, blocks, los, his: the zone maps of up to ATLAS blocks in a row."""
    maps = F.array_sort(F.collect_list(F.struct("block", "lo", "hi")))
    pages = packs.groupBy(F.floor(F.col("block") / ATLAS).alias("page")).agg(maps.alias("m"))
    return cut(pages.select("page", F.col("m.block").alias("blocks"), F.flatten("m.lo").alias("los"), F.flatten("m.hi").alias("his")))


RESULT = [("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long")]

#: For DuckDB: all scores of the anchors, `anchor_every` and `twist_every` filled in by the query.
SQL = """
WITH rows AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % {twist} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::bigint AS score FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % {every} = 0),
positives AS (SELECT anchor, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER w::int AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5
"""
