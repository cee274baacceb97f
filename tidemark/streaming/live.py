"""Projections that Structured Streaming keeps up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.fold import Step
from tidemark.operators.stream import Batch
from tidemark.plans.store import Store


def fold_stream(rows: DataFrame, step: Step, store: Store, name: str, cursor: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Fold each micro-batch of a streaming frame into the store's state `name`.

    The checkpoint holds the source's position; a batch that is repeated after a failure bears the id that the store has
    seen, and is not folded twice. every: a processing-time trigger (polling); None: run until caught up, then end.
    """

    def fold(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            ends = df.agg(F.max(cursor).alias("end"), F.count("*").alias("n")).first()
            if ends["n"]:
                store.put(name, step(store.get(name), Batch(df, None, ends["end"], ends["n"])), f"{name}-{batch_id}")
        finally:
            df.unpersist()

    writer = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def side_effects(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call act(rows, batch id) for each micro-batch; after a failure the last batch may come again under its id."""
    writer = rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def windowed(rows: DataFrame, time: str, width: str, late: str, keys: list[str], **values) -> DataFrame:
    """Event-time windows with a watermark: keys, window_start and aggregate columns of a streaming or a batch frame."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*(c.alias(n) for n, c in values.items())).select(*keys, F.col("w.start").alias("window_start"), *values)
