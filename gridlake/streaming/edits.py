"""Edits as a stream: each micro-batch is one what-if on the model as it stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlake.operators import live


class Model(live.Live):
    """The cells of a model (as `evaluate.with_ids` gives them), kept up to date by `apply`, which takes edits with their time ts."""


def follow(edits: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what has arrived of a stream of edits (id, v_num, v_str, ts), batch by batch; `sink` gets each batch's changes."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(model.apply(batch), number)

    return edits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of edits by window and kind; what comes later than `late` is left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
