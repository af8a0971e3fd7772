"""Vectors in blocks: principal axes, a Hilbert curve over the leading ones, and rows of many vectors with zone maps.

A block is one row: some columns of at most `size` vectors as arrays, the vectors one after the other in `flat`, and the least and
greatest value of each dimension (`lo`, `hi`). Blocks are cut from the order along a space-filling curve, so what lies in one block lies close
together, and all but the last have the same size, whatever the vectors are: ties and copies make no block larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import cut, discard, local_table

#: Leading axes that the curve runs through, and bits of each; together they fit a long.
AXES, BITS = 7, 8
#: Bytes that one Arrow batch of rows with whole blocks may hold.
BATCH_BYTES = 64 << 20


def usable(vec: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; rows of whole blocks come to Python few at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrow lists as rows of a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    x = x / np.where((most := np.abs(x).max(axis=1, initial=0)) > 0, most, 1)[:, None]
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def width_of(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes as columns, those along which the directions of all vectors vary most first. Each task sums products of
    components; what reaches the driver are width * (width + 1) / 2 sums, however many vectors there are."""
    above = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width))
        for batch in batches:
            u = unit(rows_of(batch.column(0), width))
            held += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above[0]))), pa.array(held[above])], names=["cell", "s"])

    sums = vectors.select("vec").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    moments = np.zeros((width, width))
    cell, s = sums["cell"].to_numpy(), sums["s"].to_numpy()
    moments[above[0][cell], above[1][cell]] = moments[above[1][cell], above[0][cell]] = s
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on a Hilbert curve of points given by whole coordinates of `bits` bits: coordinates are unfolded from the highest bit down by
    exchanging and inverting axes, and their bits are interleaved in Gray code."""
    x = cells.astype("i8").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swapped)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> bit & 1)
    return place


def ordered(vectors: DataFrame, axes: np.ndarray, tie: str) -> DataFrame:
    """The vectors (other columns, then vec), written in the order of their directions along the curve, with `place`: 0, 1, ...

    Ranges of the curve are sorted by Spark; what reaches the driver is how many vectors each range has."""
    width = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = unit(rows_of(batch.column("vec"), width)) @ axes[:, :AXES]
            cells = np.clip(((turned + 1) / 2 * (1 << BITS)).astype("i8"), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells), pa.int64())], names=[*batch.schema.names, "curve"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    keyed = cut(vectors.mapInArrow(run, f"{kind}, curve long"))
    ranged = keyed.repartitionByRange("curve", tie).sortWithinPartitions("curve", tie)
    numbered = cut(ranged.withColumn("_in", F.monotonically_increasing_id()))
    part = F.shiftright("_in", 33)
    counts = sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *[r["n"] for r in counts]]).tolist()
    starts = local_table(vectors.sparkSession, [(r["part"], b) for r, b in zip(counts, before, strict=False)], "part long, before long")
    out = cut(numbered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("_in").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "_in", "curve"))
    discard(keyed, numbered)
    return out


def packed(rows: DataFrame, place: str, columns: dict[str, str], size: int, width: int, measured: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """block, the `columns` (name and type of an element) as arrays, flat, lo, hi: a row for each `size` vectors by `place`. lo and hi
    are the bounds of each dimension of what `measured` makes of the vectors."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        x = rows_of(t["vec"], width)
        z = measured(x)
        lists = [pa.array([t[c].to_pylist()], pa.list_(types[k])) for c, k in columns.items()]
        flat = [pa.array([v], pa.list_(pa.float64())) for v in (x.ravel(), z.min(axis=0), z.max(axis=0))]
        return pa.table([pa.array([t["block"][0].as_py()], pa.int64()), *lists, *flat], names=["block", *columns, "flat", "lo", "hi"])

    schema = ", ".join(["block long", *(f"`{c}` array<{k}>" for c, k in columns.items()), "flat array<double>", "lo array<double>", "hi array<double>"])
    dealt = rows.select(F.floor(F.col(place) / size).alias("block"), F.col(place).alias("place"), *(c for c in columns if c != "place"), "vec")
    return dealt.groupBy("block").applyInArrow(run, schema)
