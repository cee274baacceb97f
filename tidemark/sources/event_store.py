"""Sources over an event store, a command scheduler and a log of commits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cursor import unread
from tidemark.operators.partition import Partition
from tidemark.operators.stream import Stream, as_stream, create

EVENTS, CHANGES, PER_KEY, CLOCKS, COMMANDS, STREAMS = 100, 10, 1000, 1, 5, 100_000


def events(df: DataFrame, cursor: str = "event_id", keep: Column | None = None, key: str | None = None, partition: Partition | None = None, id: str = "events") -> Stream:
    """All events in global order, filtered and within a partition of the key; 100 a batch by default."""
    rows = df if keep is None else df.where(keep)
    if partition is not None:
        rows = rows.where(partition.predicate(F.col(key)))
    return Stream(id, lambda: rows, cursor, batch_size=EVENTS)


def change_feed(df: DataFrame, key: str, cursor: str = "event_id", kind: str | None = None, partition: Partition | None = None) -> Stream:
    """Keys that changed in a batch of events: key, kind of its first event, `last` (its largest cursor)."""

    def changes(rows: DataFrame) -> DataFrame:
        more = [F.min_by(kind, cursor).alias(kind)] if kind else []
        return rows.groupBy(key).agg(*more, F.max(cursor).alias("last"))

    made = events(df, cursor, None, key, partition, "changes").map(changes, "changes")
    return Stream(made.id, made.source, made.cursor, made.first, CHANGES, made.steps)


def per_key(df: DataFrame, key: str, cursor: str = "event_id", partition: Partition | None = None) -> Stream:
    """Events of the keys that changed, within the feed's range: after its position, up to the end of its batch."""
    feed = events(df, cursor, None, key, partition, "changes")
    return Stream(feed.id, feed.source, cursor, batch_size=CHANGES).into_many(as_stream(df, cursor, "per-key"), key)


def clocks_due(clocks: DataFrame, commands: DataFrame, on: str, due: Column, partition: Column | None = None, order: tuple[str, ...] = (), n: int | None = CLOCKS) -> DataFrame:
    """Clocks joined to each of their due commands: a clock stands as often as it has due commands."""
    rows = (clocks if partition is None else clocks.where(partition)).join(commands.where(due), on)
    return rows if n is None else rows.orderBy(*order).limit(n)


def commands_due(commands: DataFrame, due: Column, clock: Column, partition: Column | None = None, order: tuple[str, ...] = (), n: int | None = COMMANDS) -> DataFrame:
    """Due commands of one clock; an order makes the choice of n definite."""
    rows = commands.where(due & clock)
    rows = rows if partition is None else rows.where(partition)
    return rows if n is None else rows.orderBy(*order).limit(n)


def one_key(df: DataFrame, key: str, value: Any, revision: str, after: int = -1, n: int = PER_KEY) -> DataFrame:
    """Revisions (after, after + n] of one key."""
    r = F.col(revision)
    return df.where((F.col(key) == F.lit(value)) & (r > after) & (r <= after + n))


def whole_commits(df: DataFrame, commit: str, size: int, after: Any = None) -> DataFrame:
    """Rows of the next whole commits whose rows, summed up in order of commits, number `size` at most.

    At most `size` commits can fit, so only the first size + 1 are counted up, whatever the table holds. A first commit
    that is larger comes alone, so that a reader goes on.
    """
    fresh = df.where(unread(F.col(commit), after) & F.col(commit).isNotNull())
    sizes = fresh.groupBy(commit).agg(F.count("*").alias("_n")).orderBy(commit).limit(size + 1)
    order = Window.orderBy(commit)
    fits = sizes.select(commit, F.sum("_n").over(order).alias("_upto"), F.row_number().over(order).alias("_i")).where((F.col("_upto") <= size) | (F.col("_i") == 1))
    return fresh.join(F.broadcast(fits.select(commit)), commit, "left_semi")


def one_key_stream(df: DataFrame, key: str, value: Any, revision: str, n: int = PER_KEY) -> Stream:
    """One key's rows in the order of their revisions, of which the first is 0."""
    return create(f"{key}={value}", lambda position, size: one_key(df, key, value, revision, position, size or (1 << 62)), lambda rows, position: rows.agg(F.coalesce(F.max(revision), F.lit(position))).first()[0], -1, n)


def commits(df: DataFrame, commit: str, n: int = EVENTS, id: str = "commits") -> Stream:
    """Whole commits, as many in a batch as n rows have room for; the cursor is the last one's number."""

    def query(position: Any, size: int | None) -> DataFrame:
        return df.where(unread(F.col(commit), position) & F.col(commit).isNotNull()) if size is None else whole_commits(df, commit, size, position)

    return create(id, query, lambda rows, position: rows.agg(F.coalesce(F.max(commit), F.lit(position))).first()[0], None, n)


def distinct_key_stream(df: DataFrame, commit: str, key: str, n: int = EVENTS) -> Stream:
    """The keys of each batch of commits, each once a batch."""
    return commits(df, commit, n, "keys").map(lambda rows: rows.select(key).distinct(), "distinct")


def key_streams(df: DataFrame, key: str, token: str, revision: str, n: int = STREAMS) -> Stream:
    """Keys in the order of their last token with their heads; into_many() on the key gives the rows of each."""
    heads = df.groupBy(key).agg(F.max(token).alias(token), F.max(revision).alias(revision))
    return Stream("key-streams", lambda: heads, token, batch_size=n)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Each key once."""
    return df.select(key).distinct()


def keys_with_heads(df: DataFrame, key: str, token: str, revision: str) -> DataFrame:
    """Each key with its last token and revision."""
    return df.groupBy(key).agg(F.max(token).alias(token), F.max(revision).alias(revision))
