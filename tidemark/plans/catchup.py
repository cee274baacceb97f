"""Catching up: fetch a batch, fold it into every subscriber's state, save, repeat."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cursor import Cursor, literal, min_or_default, unread
from tidemark.operators.fold import CURSOR, Step
from tidemark.operators.partition import Partition
from tidemark.operators.stream import Batch, PartitionedStream, Stream, semi_join
from tidemark.plans.store import CallableCursors, CursorStore, MemoryStore, Store

log = logging.getLogger("tidemark")
Cursors = CursorStore | CallableCursors
#: Before all positions.
_ALL = object()


@dataclass
class Failure:
    """What a subscriber raised; go_on() keeps its old state and cursor and lets the others continue."""

    error: Exception
    batch: Batch
    subscriber: str
    handled: bool = False

    def go_on(self) -> None:
        self.handled = True


@dataclass
class _Subscriber:
    name: str
    step: Step | None
    act: Callable[[Batch], None] | None
    store: Store
    on_error: Callable[[Failure], None] | None
    cursor: Cursor
    #: Up to here every row has been folded; _ALL: not even the first.
    since: Any = _ALL

    def load(self) -> DataFrame | None:
        """State, and the cursor that stands in its rows."""
        state = self.store.get(self.name)
        if state is not None and CURSOR in state.columns and self.cursor.position is None:
            self.cursor.advance_to(state.agg(F.max(CURSOR)).first()[0])
        return state


class Catchup:
    """One stream, any number of subscribers; a batch is fetched once for all of them.

    It begins at `cursor` if one is given, else at the subscriber furthest behind, and each subscriber gets only rows
    beyond its own position. The batch is cached while several fold it. Saved cursors never move back.

    cursors, if given, keeps positions between runs: that of `cursor` under the stream's id, or those of subscribers under
    (the stream's id, their name). A position is saved after what it covers, so a crash between repeats a batch: folds
    skip rows that their state has seen, and act() must bear the repetition.
    """

    def __init__(self, stream: Stream, cursor: Cursor | None = None, batch_size: int | None = -1, cursors: Cursors | None = None):
        self.stream, self.cursor, self.batch_size, self.cursors = stream, cursor, batch_size, cursors
        if cursors is not None and cursor is not None and (at := cursors.get(stream.id)) is not None:
            cursor.advance_to(at)
        self.error: Exception | None = None
        self.subscribers: list[_Subscriber] = []
        self._gate, self.rows_seen = threading.Lock(), 0
        self.last: Batch | None = None

    def subscribe(self, step: Step | None = None, store: Store | None = None, name: str | None = None, act: Callable[[Batch], None] | None = None, on_error: Callable[[Failure], None] | None = None) -> Callable[[], None]:
        """Fold batches with step into store (in memory by default), or act on them; returns what ends it."""
        name = name or f"{self.stream.id}-{len(self.subscribers)}".replace("/", "_").replace(":", "_")
        made = _Subscriber(name, step, act, store or MemoryStore(), on_error, Cursor(self.stream.first))
        if self.cursors is not None and self.cursor is None and (at := self.cursors.get(self.stream.id, name)) is not None:
            made.cursor.advance_to(at)
        if self.cursors is not None and self.cursor is not None and (at := self.cursors.get(self.stream.id, f"{name}/since")) is not None:
            made.since = at
        self.subscribers.append(made)
        return lambda: self.subscribers.remove(made) if made in self.subscribers else None

    def run_single_batch(self) -> int:
        """Rows fetched from the source. A second caller waits for the batch that is under way and gets its count."""
        if not self._gate.acquire(blocking=False):
            with self._gate:
                return self.last.count if self.last else 0
        try:
            return self._run()
        finally:
            self._gate.release()

    def _run(self) -> int:
        if not self.subscribers:
            return 0
        states = [s.load() for s in self.subscribers]
        cursor = self.cursor or min_or_default(s.cursor for s in self.subscribers)
        batch = self.last = self.stream.fetch(cursor, self.batch_size)
        if batch.is_empty:
            return 0
        many = len(self.subscribers) > 1
        if many:
            batch.df.persist()
        try:
            for s, state in zip(list(self.subscribers), states):
                self._deliver(s, state, batch)
        except Exception:
            if self.cursor is not None:  # the batch comes again
                self.cursor.advance_to(batch.starts_at)
            raise
        finally:
            if many:
                batch.df.unpersist()
        if self.cursors is not None and self.cursor is not None:
            self.cursors.put(self.stream.id, self.cursor.position)
        self.rows_seen += batch.count
        return batch.count

    def _deliver(self, s: _Subscriber, state: DataFrame | None, batch: Batch) -> None:
        ahead = self.cursor is None and s.cursor.position is not None and s.cursor.position != batch.starts_at
        at = self.stream.cursor
        own = batch.prune(at, s.cursor) if ahead and (not isinstance(at, str) or at in batch.df.columns) else batch
        try:
            if s.act is not None:
                s.act(own)
            else:
                s.store.put(s.name, s.step(state, own), f"{batch.starts_at}-{batch.ends_at}")
        except Exception as e:
            failure = Failure(e, own, s.name)
            if s.on_error is not None:
                s.on_error(failure)
            if not failure.handled:
                raise
            return
        if not s.cursor.has_reached(batch.ends_at):
            s.cursor.advance_to(batch.ends_at)
            if self.cursors is not None and self.cursor is None:
                self.cursors.put(self.stream.id, batch.ends_at, s.name)
        if s.since is not _ALL and s.since == batch.starts_at or s.since is _ALL and batch.starts_at == self.stream.first:
            s.since = batch.ends_at
            if self.cursors is not None and self.cursor is not None:
                self.cursors.put(self.stream.id, s.since, f"{s.name}/since")

    def run_until_caught_up(self, seconds: float = 4 * 3600, lease=None) -> int:
        """Batches until one has no source rows or moves no one, time is up or the lease is over; returns the rows seen."""
        end, total, at = time.monotonic() + seconds, 0, None
        while time.monotonic() < end and not (lease and lease.is_over) and (n := self.run_single_batch()):
            total += n
            before, at = at, [self.cursor.position] if self.cursor else [s.cursor.position for s in self.subscribers]
            if at == before:  # only subscribers that fail again and again are behind
                break
        return total

    def poll(self, seconds: float, on_exception: Callable[[Exception], None] | None = None) -> Callable[[], None]:
        """Run batches in the background, pausing after each; returns what stops it.

        What a batch raises is logged, kept in `error` and told, and the next one is tried after the pause.
        """
        over = threading.Event()

        def loop() -> None:
            while not over.is_set():
                try:
                    self.run_single_batch()
                except Exception as e:
                    self.error = e
                    log.exception("%s: a batch failed", self.stream.id)
                    if on_exception is not None:
                        on_exception(e)
                over.wait(seconds)

        worker = threading.Thread(target=loop, daemon=True)
        worker.start()
        return lambda: (over.set(), worker.join())[0]


class KeyedCatchup(Catchup):
    """Streams of many keys at once: a feed of changes names the keys, and one job folds the unread rows of all of them.

    Each key's state row holds its own cursor, so rows that a key has seen are not folded again. A key that failed
    (PythonFold's error column) keeps its state and is read again from its own cursor when it next changes. Rows are read
    from just after the batch's start, or from the least position that a failed key or subscriber has stopped at; from
    the first row only where a subscriber may lack history. A null key is a key like others.
    """

    def __init__(self, feed: Stream, rows: Callable[[], DataFrame], key: str, cursor: Cursor | None = None, batch_size: int | None = -1, cursors: Cursors | None = None):
        def expand(batch: Batch) -> Batch:
            c, low = feed.cursor_column, self._floor(batch.starts_at)
            some = rows().where(c <= literal(batch.ends_at))
            if low is not _ALL:
                some = some.where(unread(c, low))
            return Batch(semi_join(some, batch.df.select(key).distinct(), key), batch.starts_at, batch.ends_at, batch.count)

        upstream = Stream(f"{feed.id}/all", feed.source, feed.cursor, feed.first, feed.batch_size, (*feed.steps, expand), feed.before, feed.advance)
        super().__init__(upstream, cursor or Cursor(feed.first), batch_size, cursors)

    def _floor(self, start: Any) -> Any:
        """Where the oldest row may stand that one of the batch's keys has yet to fold."""
        low = start
        for s in self.subscribers:
            if s.since is _ALL and start != self.stream.first:
                return _ALL
            stops = [] if s.since is _ALL else [s.since]
            state = s.store.get(s.name) if s.step is not None else None
            if state is not None and "error" in state.columns:
                failed = state.where("error is not null").agg(F.min(CURSOR).alias("at"), F.count("*").alias("n"), F.count(CURSOR).alias("some")).first()
                if failed["n"] > failed["some"]:
                    return _ALL
                stops += [failed["at"]] * (failed["n"] > 0)
            for at in stops:
                if at is None or low is None:
                    return _ALL
                low = min(low, at)
        return low


class PartitionedCatchup:
    """One catch-up for each partition, with cursors and state of their own, run as a distributor grants leases.

    cursors keeps each partition's positions between runs. keyed makes another kind of catch-up of a partition's stream.
    """

    def __init__(self, stream: PartitionedStream, partitions: list[Partition], batch_size: int | None = -1, keyed: Callable[[Stream], Catchup] | None = None, cursors: Cursors | None = None):
        make = keyed or (lambda s: Catchup(s, batch_size=batch_size, cursors=cursors))
        self.parts = {str(p): make(stream.get(p)) for p in partitions}

    def subscribe(self, step: Step | None = None, store: Store | None = None, name: str = "projection", **options) -> None:
        """The same fold for all partitions; each saves under its own name."""
        store = store or MemoryStore()
        for i, part in enumerate(self.parts.values()):
            part.subscribe(step, store, f"{name}-{i}", **options)

    def receive(self, lease) -> int:
        """One batch of the partition that a lease names."""
        return self.parts[lease.resource].run_single_batch()

    def receive_all(self, lease) -> int:
        """Batches of the partition that a lease names until it is caught up or the lease is over."""
        return self.parts[lease.resource].run_until_caught_up(lease=lease)

    def run_single_batch(self) -> dict[str, int]:
        """One batch of every partition."""
        return {name: part.run_single_batch() for name, part in self.parts.items()}

    def run_until_caught_up(self) -> dict[str, int]:
        return {name: part.run_until_caught_up() for name, part in self.parts.items()}

    def cursors(self) -> dict[str, Any]:
        """Where each partition stands."""
        return {name: (part.cursor or min_or_default(s.cursor for s in part.subscribers)).position for name, part in self.parts.items()}


def backoff(distributor, work: Callable[[Any], int], seconds: float) -> Callable[[Any], int]:
    """work that extends a lease in which it saw no rows, so that its partition rests."""

    def run(lease) -> int:
        n = work(lease)
        if not n:
            lease.expire_in(seconds)
            lease.keep = True
        return n

    return run
