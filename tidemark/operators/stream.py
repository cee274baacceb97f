"""Streams: data frames read in order of a cursor, batch by batch, from any position."""

from __future__ import annotations

import functools
import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cursor import Cursor, literal, unread
from tidemark.operators.partition import Partition
from tidemark.plans.shared import kept

log = logging.getLogger("tidemark")
BATCH_SIZE = 1000
#: Up to so many rows the end of a batch is a top-n, of which every task, and then a single one, holds all n.
TOP_N = 1 << 19


@dataclass
class Batch:
    """Rows of one fetch, with the positions before and after it."""

    df: DataFrame
    starts_at: Any
    ends_at: Any
    #: Rows fetched from the source, whatever later steps made of them.
    count: int

    @property
    def is_empty(self) -> bool:
        return self.count == 0

    def prune(self, column: str | Column, cursor: Cursor) -> Batch:
        """Without the rows that cursor has reached."""
        return replace(self, df=self.df.where(cursor.unread(F.col(column) if isinstance(column, str) else column)))


def semi_join(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """The rows whose values of the named columns are among keys; nulls equal nulls."""
    these = keys.select(*(F.col(n).alias(f"_key_{n}") for n in names))
    return rows.join(these, functools.reduce(lambda a, b: a & b, (rows[n].eqNullSafe(these[f"_key_{n}"]) for n in names)), "left_semi")


def last_of(keys: DataFrame, n: int | None) -> tuple[Any, int]:
    """The largest of the n least values (n: None for all) of keys' one column, c, and how many there are: n or fewer.

    For a large n the values are counted by ranges, and only the range in which the n-th lies is looked into further.
    """
    below, c = 0, F.col("c")
    while n is not None and n - below > TOP_N:
        parts = keys.repartitionByRange(max(64, 4 * (n - below) // TOP_N), "c").groupBy(F.spark_partition_id()).agg(F.max("c").alias("end"), F.count("*").alias("n"))
        low, whole, inside = None, below, None
        for end, size in parts.orderBy("end").select("end", "n").collect():
            if below + size >= n:
                inside = end, size
                break
            low, below = (end,), below + size
        if inside is None:  # there are fewer
            return (low[0] if low else None), below
        end, size = inside
        if below + size == n:
            return end, n
        keys = keys.where(c <= literal(end) if low is None else unread(c, low[0]) & (c <= literal(end)))
        if below == whole and size > TOP_N:  # few values, with many ties: the range may be the same again
            least = keys.where(c < literal(end))
            if (size := least.count()) < n - below:
                return end, n
            keys = least
    one = (keys if n is None else keys.orderBy("c").limit(n - below)).agg(F.max("c").alias("end"), F.count("*").alias("n")).first()
    return one["end"], below + one["n"]


@dataclass(frozen=True)
class Stream:
    """Rows of `source` in the order of `cursor`, a column's name or a column expression.

    A fetch finds the last cursor value of the next n rows (a top-n over that one column, or counts of its ranges where n
    passes TOP_N) and then scans the range (start, end], which Catalyst pushes to the source. Rows that share a cursor value are never parted, so a batch can
    pass n by the ties of its last value: order by a struct of columns (cursor=F.struct(...)) where many rows share one.
    Steps added by map() don't change where a batch ends. Rows with a null cursor are never read. A first position other
    than None is read from just after it.

    A source that takes two arguments is a query of its own, called with the position and the batch size (None: all).
    With `advance` its rows are the batch as they stand, and advance(rows, position) says where it ends; without, the
    stream still bounds and orders what the query returns.
    """

    id: str
    source: Callable[..., DataFrame]
    cursor: str | Column
    first: Any = None
    batch_size: int | None = BATCH_SIZE
    steps: tuple[Callable[[Batch], Batch], ...] = ()
    before: tuple[Callable[[Any, int | None], None], ...] = field(default=(), compare=False)
    advance: Callable[[DataFrame, Any], Any] | None = field(default=None, compare=False)

    def new_cursor(self) -> Cursor:
        return Cursor(self.first)

    def rows(self, position: Any = None, n: int | None = None) -> DataFrame:
        """What the source has, or what its query gives for a position and a batch size."""
        return self.source(position, n) if len(inspect.signature(self.source).parameters) >= 2 else self.source()

    @property
    def cursor_column(self) -> Column:
        return F.col(self.cursor) if isinstance(self.cursor, str) else self.cursor

    def fetch(self, cursor: Cursor | None = None, n: int | None = -1, upto: Any = None) -> Batch:
        """The next batch after cursor (default: the start), which then advances. n: None for all, -1 for the default."""
        cursor = cursor if cursor is not None else self.new_cursor()
        n = self.batch_size if n == -1 else n
        start = cursor.position
        for seen in self.before:
            seen(start, n)
        column, df = self.cursor_column, self.rows(start, n)
        if self.advance is not None:
            return self._advanced(df, cursor, start)
        fresh = df.where(unread(column, start) & column.isNotNull())
        if upto is not None:
            fresh = fresh.where(column <= literal(upto))
        keys = fresh.select(column.alias("c"))
        end, found = last_of(keys, n)
        if not found:
            batch = Batch(fresh.limit(0), start, start, 0)
        else:
            rows = fresh.where(column <= literal(end))
            batch = Batch(rows, start, end, found if n is None or found < n else rows.select(column).count())
            cursor.advance_to(end)
        return self._stepped(batch)

    def _advanced(self, rows: DataFrame, cursor: Cursor, start: Any) -> Batch:
        """A query's rows as a batch; its cursor moves where advance says, also for no rows."""
        count, end = rows.count(), self.advance(rows, start)
        cursor.advance_to(end)
        return self._stepped(Batch(rows, start, end, count))

    def _stepped(self, batch: Batch) -> Batch:
        for step in self.steps:
            batch = step(batch)
        return batch

    def map(self, f: Callable[[DataFrame], DataFrame], name: str = "map") -> Stream:
        """Each batch's rows through f: any projection, filter or expansion."""
        return replace(self, id=f"{self.id}/{name}", steps=(*self.steps, lambda b: replace(b, df=f(b.df))))

    def filter(self, condition: Column) -> Stream:
        return self.map(lambda df: df.where(condition), "filter")

    def into_many(self, downstream: Stream, key: str, bounded: bool = True, changes: Callable[[DataFrame], DataFrame] | None = None) -> Stream:
        """For each key of a batch, downstream's rows of that key, all keys in one semi-join.

        bounded: only rows in the batch's range (start, end] of the shared cursor. The cursor is this stream's own.
        """

        def expand(batch: Batch) -> Batch:
            keys = (changes or (lambda df: df))(batch.df).select(key).distinct()
            c = downstream.cursor_column
            rows = downstream.rows(batch.starts_at, None)
            if bounded:
                rows = rows.where(unread(c, batch.starts_at) & (c <= literal(batch.ends_at)))
            made = replace(batch, df=semi_join(rows, keys, key))
            for step in downstream.steps:
                made = step(made)
            return made

        return replace(self, id=f"{self.id}/{downstream.id}", steps=(*self.steps, expand))

    def trace(self, on_query: Callable[[Any, int | None], None] | None = None, on_results: Callable[[Batch], None] | None = None) -> Stream:
        """Tell of each fetch and its result; without callbacks, log both."""
        if on_query is None and on_results is None:
            on_query = lambda at, n: log.info("%s: asks for %s rows after %r", self.id, "all" if n is None else n, at)
            on_results = lambda b: log.info("%s: got %d rows up to %r", self.id, b.count, b.ends_at)

        def tell(batch: Batch) -> Batch:
            if on_results:
                on_results(batch)
            return batch

        return replace(self, before=(*self.before, on_query) if on_query else self.before, steps=(*self.steps, tell))

    def within(self, key: str, partition: Partition) -> Stream:
        """The rows of one partition, cursors apart from those of others."""
        return replace(self, id=f"{self.id}/{partition}", source=lambda position, n: self.rows(position, n).where(partition.predicate(F.col(key))))

    def partitioned(self, key: str) -> PartitionedStream:
        return PartitionedStream(self.id, self, key)

    def aggregate(self, fold, state: DataFrame | None = None, cursor: Cursor | None = None) -> DataFrame:
        """All unread rows folded into state at once; the positions are those of the state's rows or of cursor."""
        batch = self.fetch(cursor, None)
        return state if batch.is_empty and state is not None else fold(state, batch)


@dataclass(frozen=True)
class PartitionedStream:
    """A stream that is read partition by partition."""

    id: str
    stream: Stream
    key: str

    def get(self, partition: Partition) -> Stream:
        return self.stream.within(self.key, partition)

    def map(self, f: Callable[[DataFrame], DataFrame]) -> PartitionedStream:
        return replace(self, stream=self.stream.map(f))

    def into_many(self, downstream: Stream, key: str, bounded: bool = True) -> PartitionedStream:
        return replace(self, stream=self.stream.into_many(downstream, key, bounded))

    def trace(self, on_query=None, on_results=None) -> PartitionedStream:
        return replace(self, stream=self.stream.trace(on_query, on_results))


def as_stream(df: DataFrame, cursor: str | Column, id: str = "stream", first: Any = None) -> Stream:
    """A data frame ordered by one of its columns or by an expression of them."""
    return Stream(id, lambda: df, cursor, first)


def create(id: str, query: Callable[[Any, int | None], DataFrame], advance: Callable[[DataFrame, Any], Any], first: Any = None, batch_size: int | None = BATCH_SIZE) -> Stream:
    """A stream of a query of one's own: query(position, n) gives a batch's rows, advance(rows, position) its end."""
    return Stream(id, query, "", first, batch_size, advance=advance)


def as_sequential_stream(df: DataFrame, order: list[str], id: str = "stream") -> Stream:
    """A data frame whose cursor, `position`, counts its rows from 1 in the given order, which must be total.

    Rows are numbered once, at the first fetch, in a table of the shared folder; a fetch reads only the parts of it that
    its range of positions touches.
    """
    tables: list[_Numbered] = []

    def source(position: int | None, n: int | None) -> DataFrame:
        if not tables:
            tables.append(_Numbered(df, order))
        low = position or 0
        return tables[0].rows("position", low, None if n is None else low + n)

    return Stream(id, source, "position", 0)


class _Numbered:
    """df's rows sorted and numbered within ranges of the order, as a table with a folder for each range.

    The table is written once: to sort again would draw other ranges. Only the sizes of ranges, as many as tasks wrote
    it, are held by the driver.
    """

    def __init__(self, df: DataFrame, order: list[str]):
        at = F.monotonically_increasing_id()
        parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
        self.table = kept(parted.select(*df.columns, F.col("_at").bitwiseAND((1 << 33) - 1).alias("_within"), F.shiftright("_at", 33).alias("_part")), partition_by=("_part",))
        self.bases: list[tuple[int, int, int]] = []
        total = 0
        for part, n in sorted(map(tuple, self.table.groupBy("_part").count().collect())):
            self.bases.append((part, total, n))
            total += n

    def rows(self, column: str, low: int = 0, high: int | None = None) -> DataFrame:
        """Rows whose position is in (low, high], with it in `column`; other ranges' folders are not read."""
        some = [(p, base) for p, base, n in self.bases if base + n > low and (high is None or base < high)]
        spark, table = self.table.sparkSession, self.table
        if len(some) < len(self.bases):
            table = table.where(F.col("_part").isin([p for p, _ in some]))
        bases = spark.createDataFrame(some, "_part long, _base long")
        made = table.join(F.broadcast(bases), "_part").withColumn(column, F.col("_within") + F.col("_base") + 1)
        inside = F.col(column) > low if high is None else (F.col(column) > low) & (F.col(column) <= high)
        return (made if low == 0 and high is None else made.where(inside)).drop("_part", "_within", "_base")


def numbered(df: DataFrame, order: list[str], column: str = "position") -> DataFrame:
    """df with row numbers from 1 in a total order, without a window over all rows in one task.

    The sorted rows are a table in the shared folder, written by this call; the order of df's columns is kept, and its
    number comes last. An empty df gives no rows.
    """
    return _Numbered(df, order).rows(column)


class StreamBuilder:
    """Step by step: Stream.of("x").cursor("c", first).batches_of(n).partition_by("k").create(source)."""

    def __init__(self, id: str):
        self._id, self._cursor, self._first, self._size, self._key, self._advance = id, None, None, BATCH_SIZE, None, None

    def named(self, id: str) -> StreamBuilder:
        self._id = id
        return self

    def cursor(self, column: str | Column, starts_at: Any = None) -> StreamBuilder:
        self._cursor, self._first = column, starts_at
        return self

    def batches_of(self, n: int | None) -> StreamBuilder:
        self._size = n
        return self

    def partition_by(self, key: str) -> StreamBuilder:
        self._key = key
        return self

    def advance(self, move: Callable[[DataFrame, Any], Any], starts_at: Any = None) -> StreamBuilder:
        """move(rows, position) says where a batch of the source's query ends; no cursor column is needed then."""
        self._advance = move
        if self._cursor is None:
            self._cursor, self._first = "", starts_at
        return self

    def create(self, source: Callable[..., DataFrame]) -> Stream | PartitionedStream:
        """source() or source(position, n), as Stream describes."""
        if self._cursor is None:
            raise ValueError("a stream needs a cursor column")
        made = Stream(self._id, source, self._cursor, self._first, self._size, advance=self._advance)
        return made if self._key is None else made.partitioned(self._key)


def of(id: str) -> StreamBuilder:
    return StreamBuilder(id)
