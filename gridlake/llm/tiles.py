"""Near-duplicate vectors by a PCA-ordered comparison in tiles.

Equal vectors are one node. Nodes are put in the order of a curve through their leading principal axes and cut into
blocks; pairs of blocks are the tasks. Two unit vectors whose cosine reaches the threshold are no further apart than
sqrt(2 - 2 * least), so a pair of blocks is left out if the boxes around them are. In a tile, vectors are turned to the
principal axes, and the leading HEAD dimensions are multiplied first: what the others can add is at most the product of
the lengths of the two remainders, so most pairs stop there. Those left get all dimensions, and those within rounding of the threshold
are computed from the vectors as given. Links are not written as pairs: a tile gives, for each node with links in it,
their number and the least node that its links lead to, and components are made of these.

The number of tiles grows with the square of the blocks that the boxes cannot keep apart; nothing of a vector is shortened, and no pair is left out
that could reach the threshold.

Cases: null vectors and those with null or non-finite components, and vectors of zeros (empty ones, too), link with nothing and are rows of
their own. Shorter vectors are filled up with zeros. Repeated rows and equal vectors link with each other. A row without
an id is a row like others; a component's id is the least id in it, null if it has none, and such a row is not kept, unless it
links with nothing. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm import blocks
from gridlake.llm.common import cut, discard, with_looked_up
from gridlake.llm.minhash import components

LEAST = 0.95
#: Vectors of a block, rows and columns of a tile that are multiplied at once, leading dimensions of the first product, and the rounding of
#: products: of the first, in single precision, and of the last.
BLOCK, TILE, HEAD = 4096, 512, 16
SLACK_HEAD, SLACK = 1e-4, 1e-9


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hangs the components of linked places to the lesser one. Every place hangs to its root before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of rows of `a` and `b` whose cosine is `least` or more, tile by tile. No row is zero."""
    u, v = (blocks.unit(x) @ axes for x in (a, b))
    head = min(HEAD, u.shape[1])
    first = []
    for x in (u, v):
        rest = np.sqrt((x[:, head:] ** 2).sum(axis=1))
        first.append(np.column_stack([x[:, :head], rest]).astype("f4"))
    for s in range(0, len(u), TILE):
        for t in range(0, len(v), TILE):
            # The last column adds the product of the remainders' lengths, the most that the other dimensions can.
            open_ = first[0][s : s + TILE] @ first[1][t : t + TILE].T >= least - SLACK_HEAD
            n = np.count_nonzero(open_)
            if not n:
                continue
            if n > open_.size // 32:
                cos = u[s : s + TILE] @ v[t : t + TILE].T
                i, j = np.nonzero(cos >= least - SLACK)
                cos = cos[i, j]
                i, j = i + s, j + t
            else:
                i, j = np.nonzero(open_)
                i, j = i + s, j + t
                cos = np.einsum("ij,ij->i", u[i], v[j])
                near = cos >= least - SLACK
                i, j, cos = i[near], j[near], cos[near]
            close = np.flatnonzero(cos <= least + SLACK)
            if len(close):
                x, y = a[i[close]], b[j[close]]
                cos[close] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                good = cos >= least
                i, j = i[good], j[good]
            yield i, j


def _links(pairs: DataFrame, width: int, axes: np.ndarray, least: float) -> DataFrame:
    """node, links, least_node: for each pair of blocks the nodes that have links in it, how many vectors they link with, and the least node
    of those that are connected with them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = lambda c: batch.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                same = batch.column("a")[row] == batch.column("b")[row]
                nodes, copies = [at("place_a")], [at("copies_a")]
                a = at("flat_a").reshape(-1, width)
                b = a
                if not same:
                    b = at("flat_b").reshape(-1, width)
                    nodes, copies = [*nodes, at("place_b")], [*copies, at("copies_b")]
                node, weight = np.concatenate(nodes), np.concatenate(copies)
                links, parent, second = np.zeros(len(node), "i8"), np.arange(len(node)), 0 if same else len(a)
                for i, j in linked(a, b, axes, least):
                    if same:
                        i, j = i[(other := i != j)], j[other]
                    j = j + second
                    np.add.at(links, i, weight[j])
                    if not same:
                        np.add.at(links, j, weight[i])
                    _joined(parent, i, j)
                some = np.flatnonzero(links)
                # Places rise with nodes inside a block, and block a comes before block b.
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, node[parent])], names=["node", "links", "least_node"])

    return blocks.small_batches(pairs).mapInArrow(run, "node long, links long, least_node long")


def _near_blocks(packs: DataFrame, least: float) -> DataFrame:
    """a, b: pairs of blocks, a <= b, whose boxes are close enough. Every block meets the boxes of those after it, not their vectors."""
    boxes = packs.select("block", "lo", "hi")
    last = boxes.agg(F.max("block")).first()[0]
    ahead = boxes.select(F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence("block", F.lit(last))).alias("b"))
    met = ahead.join(boxes.select(F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")), "b")
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return met.where(apart <= 2 - 2 * least + SLACK).select("a", "b")


def near_vectors(rows: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept: a row for each row of the input. `least` is positive."""
    vec = F.transform(rows[vec_col], lambda x: x.cast("double"))
    given = rows.select(rows[id_col].alias("id"), vec.alias("vec"))
    takes_part = blocks.usable(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    # 128 bits of hash name a vector.
    key = F.when(takes_part, F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec")))
    keyed = cut(given.select("id", key.alias("key"), F.when(takes_part, F.col("vec")).alias("vec")))
    distinct = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    nodes = cut(distinct)
    width = blocks.width_of(nodes)
    alone = lambda: keyed.where("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not width:
        return alone().withColumnRenamed("id", id_col)
    axes = blocks.principal_axes(nodes, width)
    places = blocks.ordered(nodes, axes, "key")
    packs = cut(blocks.packed(places, "place", {"place": "long", "copies": "long"}, BLOCK, width, lambda x: blocks.unit(x) @ axes))
    near = cut(_near_blocks(packs, least))
    side = lambda x: packs.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("place", "copies", "flat")))
    found = cut(_links(near.join(side("a"), "a").join(side("b"), "b"), width, axes, least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node <> least_node").select(F.col("least_node").alias("leader"), F.col("node").alias("rep")))
    known = places.select(F.col("place").alias("node"), "key", "least_id", "copies").join(links, "node", "left").join(comp.withColumnRenamed("rep", "node"), "node", "left")
    known = cut(known.select("key", "least_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    discard(nodes, packs, near, found)
    total = keyed.count()
    labels = cut(known.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("held")))
    labelled = cut(with_looked_up(known.drop("least_id"), labels, "comp", "held", total).drop("comp"))
    out = with_looked_up(keyed.where("key IS NOT NULL").select("id", "key"), labelled, "key", "copies", total)
    out = out.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(alone()).withColumnRenamed("id", id_col)


#: For DuckDB: all pairs and the closure of their links.
SQL = f"""
WITH RECURSIVE given AS (SELECT vec_id, CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN NULL ELSE embedding::DOUBLE[] END AS e FROM embeddings),
vectors AS MATERIALIZED (SELECT vec_id, e, list_dot_product(e, e) AS s FROM given WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (sqrt(a.s) * sqrt(b.s)) >= {LEAST}),
reach AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id LEFT JOIN least ON least.x = vec_id
"""
