"""Scheduled commands: due ones as streams by clock, their delivery, and clocks that follow the work."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.partition import Partition
from tidemark.operators.stream import Batch, PartitionedStream, Stream, create
from tidemark.plans.lease import Handler, Lease
from tidemark.sources.event_store import CLOCKS, COMMANDS, clocks_due, commands_due

Now = Callable[[], datetime]


def clocks_due_stream(clocks: Callable[[], DataFrame], commands: Callable[[], DataFrame], on: str, due: Callable[[], Column], key: str, order: tuple[str, ...], now: Now = datetime.now) -> PartitionedStream:
    """Clocks, one row for each of their due commands, within a range of `key`; a fetch moves the cursor to now."""
    made = create("ClocksWithCommandsDue", lambda position, n: clocks_due(clocks(), commands(), on, due(), n=None), lambda rows, position: now(), batch_size=CLOCKS)
    return _Taking(made.id, made, key, order)


def commands_due_stream(commands: Callable[[], DataFrame], clock: Column, due: Callable[[], Column], key: str, order: tuple[str, ...], name: str, now: Now = datetime.now) -> PartitionedStream:
    """Due commands of one clock within a range of `key`; a fetch moves the cursor to now."""
    if not name.strip():
        raise ValueError("a clock needs a name")
    made = create(f"CommandsDueOnClock({name})", lambda position, n: commands_due(commands(), due(), clock, n=None), lambda rows, position: now(), batch_size=COMMANDS)
    return _Taking(made.id, made, key, order)


class _Taking(PartitionedStream):
    """A partitioned query of which the first n rows of each partition are a batch."""

    def __init__(self, id: str, stream: Stream, key: str, order: tuple[str, ...]):
        super().__init__(id, stream, key)
        object.__setattr__(self, "order", order)

    def get(self, partition: Partition) -> Stream:
        inner = self.stream.within(self.key, partition)

        def first(position: Any, n: int | None) -> DataFrame:
            rows = inner.source(position, n)
            return rows if n is None else rows.orderBy(*self.order).limit(n)

        return Stream(inner.id, first, inner.cursor, inner.first, inner.batch_size, inner.steps, inner.before, inner.advance)


def deliver_commands(apply: Callable[[dict], str], keys: tuple[str, ...], id_col: str, now: Now = datetime.now) -> Callable[[DataFrame | None, Batch], DataFrame]:
    """A fold that applies each command of a batch once, in workers, and appends what came of it to the state.

    State: the keys, the command's id, result (what apply returns for the row as a dict), error (what it raised, else
    null) and applied (a time). Commands whose id the state holds are not applied again. apply runs in executors and may
    run again for a command if its task is lost, as any side effect may.
    """

    def step(state: DataFrame | None, batch: Batch) -> DataFrame:
        rows, at = batch.df, now()
        fresh = rows if state is None else rows.join(state.select(F.col(id_col).alias("_done")), rows[id_col].eqNullSafe(F.col("_done")), "left_anti")
        names = list(dict.fromkeys([*keys, id_col]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", result string, error string"

        def run(parts):
            for p in parts:
                made = []
                for row in p.to_dict("records"):
                    try:
                        made.append((apply(row), None))
                    except Exception as e:
                        made.append((None, f"{type(e).__name__}: {e}"))
                told = pd.DataFrame(made, columns=["result", "error"], index=p.index, dtype=object)
                yield pd.concat([p[names], told], axis=1)

        done = fresh.mapInPandas(run, schema).withColumn("applied", F.lit(at.isoformat(" ")).cast("timestamp_ntz"))
        return done if state is None else state.unionByName(done)

    return step


def keep_clock_updated(set_clock: Callable[[datetime], object], now: Now = datetime.now) -> Handler:
    """Middleware of a distributor that sets a clock to now once a lease's work is done."""

    def run(lease: Lease, go: Callable[[Lease], object]) -> object:
        out = go(lease)
        set_clock(now())
        return out

    return run
