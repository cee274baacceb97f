"""Folds: how a batch of rows changes keyed state."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.stream import Batch

log = logging.getLogger("tidemark")
#: How an old and a new value become one.
MERGES: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda old, new: F.coalesce(old + new, old, new),
    "max": lambda old, new: F.greatest(old, new),
    "min": lambda old, new: F.least(old, new),
    "set": lambda old, new: F.array_sort(F.coalesce(F.array_union(old, new), old, new)),
    "list": lambda old, new: F.coalesce(F.concat(old, new), old, new),
    "replace": lambda old, new: F.coalesce(new, old),
}
CURSOR = "cursor_position"
#: state (None at first) and batch in, new state out.
Step = Callable[[DataFrame | None, Batch], DataFrame]


@dataclass(frozen=True)
class Fold:
    """Declarative fold: for each key, aggregates of a batch, merged into the state row by named rules.

    values: name -> (aggregate column, one of MERGES). State rows hold the keys, the values and cursor_position, the
    largest cursor of the rows folded in, so value and position are saved together. Folding batch by batch equals folding
    all rows at once, but for "replace". Rows that a key's state has passed already are left out if prune is set.
    """

    keys: tuple[str, ...]
    values: dict[str, tuple[Column, str]]
    cursor: str
    prune: bool = True

    def delta(self, df: DataFrame) -> DataFrame:
        """State made of these rows alone."""
        return df.groupBy(*self.keys).agg(*(c.alias(n) for n, (c, _) in self.values.items()), F.max(self.cursor).alias(CURSOR))

    def unseen(self, state: DataFrame, df: DataFrame) -> DataFrame:
        """The rows beyond the position of their key's state; null keys are keys like others."""
        at = state.select(*(F.col(k).alias(f"_of_{k}") for k in self.keys), F.col(CURSOR).alias("_at"))
        rows = df.join(at, functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in self.keys)), "left")
        return rows.where(F.col("_at").isNull() | (F.col(self.cursor) > F.col("_at"))).select(df.columns)

    def merge(self, state: DataFrame, delta: DataFrame) -> DataFrame:
        """One full outer join on the keys."""
        old, new = state.alias("old"), delta.alias("new")
        rules = {n: rule for n, (_, rule) in self.values.items()} | {CURSOR: "max"}
        on = functools.reduce(lambda a, b: a & b, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys))
        keys = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in self.keys]
        return old.join(new, on, "full").select(*keys, *(MERGES[r](F.col(f"old.{n}"), F.col(f"new.{n}")).alias(n) for n, r in rules.items()))

    def __call__(self, state: DataFrame | None, batch: Batch) -> DataFrame:
        if state is None:
            return self.delta(batch.df)
        return self.merge(state, self.delta(self.unseen(state, batch.df) if self.prune else batch.df))


@dataclass(frozen=True)
class PythonFold:
    """A fold in Python: fn(key, state rows, new rows) -> state rows, for each key in a worker.

    schema: DDL of the state's keys, values and cursor_position. A key whose fn raises keeps its old state and cursor, and
    its `error` column says why; on_error="raise" fails the job instead. A key's rows of one batch are one pandas frame,
    so batches bound what a worker holds.

    Frames cost some milliseconds a key, whatever it holds. With arrow set, fn gets Arrow record batches instead, the new
    rows in order of the cursor, and gives rows as tuples in the schema's order: that costs microseconds, so it suits many
    keys with few rows each. There a value that doesn't fit the schema is an error of its key, and a null key is None.
    """

    keys: tuple[str, ...]
    fn: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame] | Callable[[tuple, pa.RecordBatch, pa.RecordBatch], Iterable[tuple]]
    schema: str
    cursor: str
    on_error: str = "continue"
    prune: bool = True
    arrow: bool = False

    def __call__(self, state: DataFrame | None, batch: Batch) -> DataFrame:
        if self.arrow:
            return self._in_arrow(state, batch)
        spark, keys, fn, stop, cursor, prune = batch.df.sparkSession, list(self.keys), self.fn, self.on_error == "raise", self.cursor, self.prune
        fields = T.StructType.fromDDL(self.schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], self.schema).schema
        names = fields.names
        state = spark.createDataFrame([], self.schema) if state is None else state
        state = state.select(*names, *(["error"] if "error" in state.columns else []))

        def fold(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            errors = old["error"] if "error" in old else None
            old = old[names]
            if prune and len(old) and pd.notna(at := old[CURSOR].max()):
                new = new[new[cursor] > at]
            if new.empty:
                return old.assign(error=errors)
            try:
                return fn(key, old, new.sort_values(cursor, kind="stable"))[names].assign(error=None)
            except Exception as e:
                if stop:
                    raise
                if old.empty:
                    old = pd.DataFrame([dict(zip(keys, key))], columns=names)
                return old.assign(error=f"{type(e).__name__}: {e}")

        return state.groupBy(*keys).cogroup(batch.df.groupBy(*keys)).applyInPandas(fold, self.schema + ", error string")

    def _in_arrow(self, state: DataFrame | None, batch: Batch) -> DataFrame:
        """State and new rows side by side, sorted by key, pass a worker as one stream, which it cuts where the key changes.

        It holds one Arrow batch and the rows of one key.
        """
        fn, stop, cursor, prune, n_keys = self.fn, self.on_error == "raise", self.cursor, self.prune, len(self.keys)
        fields = T.StructType.fromDDL(self.schema)
        names, columns = fields.names, batch.df.columns
        kinds = {f.name: f.dataType for f in fields} | {"error": T.StringType()}
        made = to_arrow_schema(T.StructType([*fields, T.StructField("error", T.StringType())]))

        def key(name: str) -> Column:
            c = F.col(f"`{name}`").cast(kinds[name])
            return c + F.lit(0.0).cast(kinds[name]) if isinstance(kinds[name], (T.FloatType, T.DoubleType)) else c  # -0.0 is 0.0

        def side(df: DataFrame, new: bool) -> DataFrame:
            old_ones = [(F.lit(None) if new or n not in df.columns else F.col(f"`{n}`")).cast(t).alias(f"_old_{i}") for i, (n, t) in enumerate(kinds.items())]
            new_ones = [(F.col(f"`{n}`") if new else F.lit(None).cast(batch.df.schema[n].dataType)).alias(f"_new_{i}") for i, n in enumerate(columns)]
            return df.select(*(key(n).alias(f"_key_{i}") for i, n in enumerate(self.keys)), F.lit(new).alias("_is_new"), *old_ones, *new_ones)

        def changes(column: pa.Array) -> np.ndarray:
            """Whether each value but the first differs from the one before it; nulls are equal, and so are NaNs."""
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            try:
                differ = pc.fill_null(pc.not_equal(a, b), pa.scalar(False)).to_numpy(zero_copy_only=False)
            except pa.ArrowNotImplementedError:  # structs and arrays
                values = column.to_pylist()
                return np.array([x != y for x, y in zip(values, values[1:])], bool)
            if pa.types.is_floating(column.type):
                nan = pc.fill_null(pc.is_nan(column), pa.scalar(False)).to_numpy(zero_copy_only=False)
                differ = differ & ~(nan[1:] & nan[:-1])
            null = column.is_null().to_numpy(zero_copy_only=False)
            return differ | (null[1:] != null[:-1])

        def fold(key: tuple, old: pa.RecordBatch, new: pa.RecordBatch) -> list[tuple]:
            state = old.select(names)
            if prune and len(old) and (at := pc.max(old.column(CURSOR))).is_valid:
                new = new.filter(pc.greater(new.column(cursor), at))
            if not len(new):
                return list(zip(*(c.to_pylist() for c in old.columns)))
            try:
                rows = [(*r, None) for r in fn(key, state, new)]
                if any(len(r) != len(made) for r in rows):
                    raise ValueError(f"a row needs {len(names)} values: {', '.join(names)}")
                return rows
            except Exception as e:
                return refused(key, state, e)

        def refused(key: tuple, state: pa.RecordBatch, error: Exception) -> list[tuple]:
            if stop:
                raise error
            rows = zip(*(c.to_pylist() for c in state.columns)) if len(state) else [tuple(dict(zip(self_keys, key)).get(n) for n in names)]
            return [(*r, f"{type(error).__name__}: {error}") for r in rows]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(made), made)], schema=made)

        def split(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
            """State and new rows without the columns that only the other has."""
            is_new, parts = rows.column(n_keys), rows.columns[n_keys + 1 :]
            old, new = pa.RecordBatch.from_arrays(parts[: len(made)], names=made.names), pa.RecordBatch.from_arrays(parts[len(made) :], names=columns)
            return old.filter(pc.invert(is_new)), new.filter(is_new)

        def folded(of: list[tuple], old: pa.RecordBatch, to_old: list[int], new: pa.RecordBatch, to_new: list[int]) -> Iterator[pa.RecordBatch]:
            """The new state of whole keys, whose rows end where to_old and to_new say."""
            cut = [(k, old.slice(a, b - a), new.slice(c, d - c)) for k, a, b, c, d in zip(of, [0, *to_old], to_old, [0, *to_new], to_new)]
            results = [fold(*x) for x in cut]
            try:
                yield told([r for rs in results for r in rs])
            except (pa.ArrowException, TypeError, ValueError, OverflowError):  # find the keys whose values don't fit
                for (k, o, _), rs in zip(cut, results):
                    try:
                        one = told(rs)
                    except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                        one = told(refused(k, o.select(names), e))
                    yield one

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at: list[pa.Array] = []  # the key that goes on into the next batch, and its rows so far
            olds: list[pa.RecordBatch] = []
            news: list[pa.RecordBatch] = []
            for b in batches:
                if not len(b):
                    continue
                keyed = b.columns[:n_keys]
                at = at or [c.slice(0, 1) for c in keyed]
                starts = np.flatnonzero(functools.reduce(np.logical_or, (changes(pa.concat_arrays([k, c])) for k, c in zip(at, keyed))))
                end = int(starts[-1]) if len(starts) else 0
                if len(starts):
                    old, new = split(b.slice(0, end))
                    count = np.append(0, np.cumsum(b.column(n_keys).to_numpy(zero_copy_only=False)))[starts]
                    to_old, to_new = (starts - count + sum(map(len, olds))).tolist(), (count + sum(map(len, news))).tolist()
                    of = list(zip(*(pa.concat_arrays([k, c.take(pa.array(starts[:-1]))]).to_pylist() for k, c in zip(at, keyed))))
                    yield from folded(of, pa.concat_batches([*olds, old]), to_old, pa.concat_batches([*news, new]), to_new)
                    at, olds, news = [c.slice(end, 1) for c in keyed], [], []
                old, new = split(b.slice(end))
                olds.append(old)
                news.append(new)
            if at:
                old, new = pa.concat_batches(olds), pa.concat_batches(news)
                yield from folded([tuple(k[0].as_py() for k in at)], old, [len(old)], new, [len(new)])

        self_keys = self.keys
        both = side(batch.df, True) if state is None else side(state, False).unionAll(side(batch.df, True))
        at = [F.col(f"_key_{i}") for i in range(n_keys)]
        order = [*at, F.col("_is_new"), F.col(f"_new_{columns.index(cursor)}").asc_nulls_last()]
        return both.repartition(*at).sortWithinPartitions(*order).mapInArrow(run, self.schema + ", error string")


def pipeline(step: Step, *middleware: Callable[[DataFrame | None, Batch, Step], DataFrame]) -> Step:
    """step within middleware, each called as m(state, batch, next); the one given last is outermost."""
    for m in middleware:
        step = functools.partial(lambda inner, m, state, batch: m(state, batch, inner), step, m)
    return step


def traced(step: Step, tell: Callable[[str, Any], None] | None = None) -> Step:
    """step, telling of its batches and of what it raises, which goes on."""
    tell = tell or (lambda what, x: log.info("%s: %r", what, x))

    def run(state: DataFrame | None, batch: Batch) -> DataFrame:
        tell("folds", (batch.starts_at, batch.ends_at, batch.count))
        try:
            return step(state, batch)
        except Exception as e:
            tell("failed", e)
            raise

    return run
