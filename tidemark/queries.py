"""Registered queries of the stream engine and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cursor import Cursor, min_or_default
from tidemark.operators import partition as parts
from tidemark.operators.fold import CURSOR, Fold, PythonFold, pipeline
from tidemark.operators.stream import Batch, as_sequential_stream, as_stream, create, numbered, of
from tidemark.plans import lease, scheduler
from tidemark.plans.catchup import Catchup, KeyedCatchup, PartitionedCatchup
from tidemark.plans.shared import shared_folder
from tidemark.plans.store import CursorStore, MemoryStore, ParquetStore
from tidemark.sources import event_store
from tidemark.streaming.live import fold_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _money(kind: str, sign: int = 1):
    amount = F.col("value").cast("decimal(18,2)")
    return F.when(F.col("event_type") == kind, amount if sign > 0 else -amount)


#: Purchases credit a user's account and errors debit it.
_CHANGE_SQL = "case event_type when 'purchase' then cast(value as decimal(18,2)) when 'error' then -cast(value as decimal(18,2)) else cast(0 as decimal(18,2)) end"
_BALANCE_SQL = f"select user_id, cast(sum({_CHANGE_SQL}) as double) balance, max(event_id) cursor_position from events group by user_id"


def balance_fold() -> Fold:
    """Balance per user: decimal sums, exact in any order."""
    return Fold(("user_id",), {"balance": (F.sum(F.coalesce(_money("purchase"), _money("error", -1), F.lit(0).cast("decimal(18,2)"))), "sum")}, "event_id")


def _told(state: DataFrame) -> DataFrame:
    return state.select("user_id", F.col("balance").cast("double").alias("balance"), CURSOR)


# sources


@query("select event_id, user_id, event_type, value from events where event_id > 4999 order by event_id limit 1000")
def fetch_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = as_stream(_events(spark, sf_dir), "event_id").fetch(Cursor(4999), 1000)
    return batch.df.select("event_id", "user_id", "event_type", "value")


@query("select event_id, user_id, event_type, value from events order by event_id limit 100")
def fetch_null_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = of("events").cursor("event_id").batches_of(100).create(lambda: _events(spark, sf_dir)).fetch()
    return batch.df.select("event_id", "user_id", "event_type", "value")


@query("select c_custkey, c_name from customer where c_name > 'Customer#000000750' order by c_name limit 50")
def fetch_string_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = as_stream(_table(spark, sf_dir, "customer"), "c_name").fetch(Cursor("Customer#000000750"), 50)
    return batch.df.select("c_custkey", "c_name")


@query("select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '1995-01-01' and o_orderdate <= (select max(d) from (select o_orderdate d from orders where o_orderdate > timestamp '1995-01-01' order by d limit 200))")
def fetch_date_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = as_stream(_table(spark, sf_dir, "orders"), "o_orderdate").fetch(Cursor(datetime(1995, 1, 1)), 200)
    return batch.df.select("o_orderkey", "o_orderdate")


@query("select * from (select row_number() over (order by l_orderkey, l_linenumber) as position, l_orderkey, l_linenumber from lineitem) where position > 500 and position <= 600")
def fetch_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = as_sequential_stream(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).fetch(Cursor(500), 100)
    return batch.df.select("position", "l_orderkey", "l_linenumber")


@query("select event_id, user_id, value from events where user_id > 20 and user_id <= 40 and event_type = 'purchase' and event_id > 99 order by event_id limit 100")
def event_store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_store.events(_events(spark, sf_dir), keep=F.col("event_type") == "purchase", key="user_id", partition=parts.by_range(20, 40))
    return made.fetch(Cursor(99)).df.select("event_id", "user_id", "value")


@query("select user_id, arg_min(event_type, event_id) event_type, max(event_id) \"last\" from (select * from events where event_id > 999 order by event_id limit 500) group by user_id")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store.change_feed(_events(spark, sf_dir), "user_id", kind="event_type").fetch(Cursor(999), 500).df


@query("select event_id, user_id, event_type from events where event_id > 499 and user_id > 10 and user_id <= 60")
def per_key_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_store.per_key(_events(spark, sf_dir), "user_id", partition=parts.by_range(10, 60))
    return made.fetch(Cursor(499), None).df.select("event_id", "user_id", "event_type")


@query("with b as (select * from events where event_id > 99 order by event_id limit 10) select event_id, user_id, event_type from events where event_id > 99 and event_id <= (select max(event_id) from b) and user_id in (select user_id from b)")
def per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the keys in a feed's default batch of ten changes."""
    return event_store.per_key(_events(spark, sf_dir), "user_id").fetch(Cursor(99)).df.select("event_id", "user_id", "event_type")


@query("select n_name, c_custkey from nation join customer on n_nationkey = c_nationkey where n_name > 'NATION_1' and n_name <= 'NATION_5' and c_acctbal < 0 order by n_name, c_custkey limit 50")
def clocks_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = _table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    made = scheduler.clocks_due_stream(lambda: _table(spark, sf_dir, "nation"), lambda: commands, "n_nationkey", lambda: F.col("c_acctbal") < 0, "n_name", ("n_name", "c_custkey"))
    return made.get(parts.by_range("NATION_1", "NATION_5")).fetch(n=50).df.select("n_name", "c_custkey")


@query("select c_custkey, c_acctbal from customer where c_acctbal < 0 and c_nationkey = 7 and c_custkey > 10 and c_custkey <= 100000 order by c_custkey limit 5")
def commands_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scheduler.commands_due_stream(lambda: _table(spark, sf_dir, "customer"), F.col("c_nationkey") == 7, lambda: F.col("c_acctbal") < 0, "c_custkey", ("c_custkey",), "nation 7")
    return made.get(parts.by_range(10, 100_000)).fetch().df.select("c_custkey", "c_acctbal")


@query("select c_custkey, case when c_acctbal < -900 then null else 'delivered ' || c_name end result, c_acctbal < -900 failed from customer where c_acctbal < 0")
def deliver_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands (customers in debt) delivered in two runs of which the second finds only what the first left."""

    def apply(row: dict) -> str:
        if row["c_acctbal"] < -900:
            raise ValueError("too far gone")
        return f"delivered {row['c_name']}"

    step = scheduler.deliver_commands(apply, (), "c_custkey")
    rows = _table(spark, sf_dir, "customer").where("c_acctbal < 0")
    stream, store = as_stream(rows, "c_custkey"), ParquetStore(spark, shared_folder(spark, "delivered"))
    store.put("commands", step(None, stream.fetch(Cursor(), rows.count() // 2 + 1)))
    state = step(store.get("commands"), stream.fetch(Cursor(), None))
    return state.select("c_custkey", "result", F.col("error").isNotNull().alias("failed"))


@query("select conv_id, turn, role from conversations where conv_id = 3 and turn > 0 and turn <= 2")
def one_key_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_store.one_key_stream(_table(spark, sf_dir, "conversations"), "conv_id", 3, "turn")
    return made.fetch(Cursor(0), 2).df.select("conv_id", "turn", "role")


@query("with s as (select conv_id, count(*) n from conversations group by conv_id), c as (select conv_id, sum(n) over (order by conv_id) upto from s), f as (select max(conv_id) stop from c where upto <= 40), d as (select conv_id, sum(n) over (order by conv_id) upto from s where conv_id > (select stop from f)) select v.conv_id, v.turn from conversations v join d on d.conv_id = v.conv_id where d.upto <= 40")
def commit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch of whole commits."""
    stream, at = event_store.commits(_table(spark, sf_dir, "conversations"), "conv_id", 40), Cursor()
    stream.fetch(at)
    return stream.fetch(at).df.select("conv_id", "turn")


@query("select distinct user_id from events")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store.distinct_key_stream(_events(spark, sf_dir), "event_id", "user_id").fetch(n=None).df


@query("select c.conv_id, c.turn, h.last_turn from conversations c join (select conv_id, max(turn) last_turn from conversations group by conv_id) h on h.conv_id = c.conv_id")
def keys_with_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their heads, expanded into the turns of each."""
    turns = _table(spark, sf_dir, "conversations")
    heads = event_store.key_streams(turns.withColumn("token", F.col("conv_id")), "conv_id", "token", "turn")
    last = heads.fetch(n=None).df.select("conv_id", F.col("turn").alias("last_turn"))
    each = heads.into_many(as_stream(turns, "conv_id", "turns"), "conv_id", bounded=False).fetch(n=None).df
    return each.join(last, "conv_id").select("conv_id", "turn", "last_turn")


# stream to stream


@query("select event_id, user_id from (select * from events where event_id > 1999 order by event_id limit 1000) where event_type = 'purchase'")
def map_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = as_stream(_events(spark, sf_dir), "event_id").filter(F.col("event_type") == "purchase").map(lambda df: df.select("event_id", "user_id"))
    return made.fetch(Cursor(1999)).df


@query("select count(*) filter (where event_type = 'error') emitted, count(*) fetched, max(event_id) cursor_position from (select * from events order by event_id limit 250)")
def map_cursor_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = as_stream(_events(spark, sf_dir), "event_id").filter(F.col("event_type") == "error").fetch(n=250)
    return batch.df.agg(F.count("*").alias("emitted")).select("emitted", F.lit(batch.count).cast("long").alias("fetched"), F.lit(batch.ends_at).alias(CURSOR))


@query("with b as (select * from events where event_id > 999 order by event_id limit 500) select e.event_id, e.user_id, e.event_type from events e where e.event_id > 999 and e.event_id <= (select max(event_id) from b) and e.user_id in (select user_id from b)")
def into_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    made = as_stream(rows, "event_id").into_many(as_stream(rows, "event_id", "per-user"), "user_id")
    return made.fetch(Cursor(999), 500).df.select("event_id", "user_id", "event_type")


@query("select l_orderkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) quantity from lineitem where l_orderkey in (select o_orderkey from orders order by o_orderkey limit 500) group by l_orderkey")
def into_many_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = as_stream(_table(spark, sf_dir, "orders").withColumn("l_orderkey", F.col("o_orderkey")), "l_orderkey", "orders")
    made = orders.into_many(as_stream(_table(spark, sf_dir, "lineitem"), "l_orderkey", "lines"), "l_orderkey")
    lines = made.map(lambda df: df.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")))
    return lines.fetch(n=500).df


@query("select cast(floor(balance / 100) as bigint) band, count(*) users from (" + _BALANCE_SQL + ") group by 1")
def stream_over_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = as_stream(_events(spark, sf_dir), "event_id").aggregate(balance_fold())
    return as_stream(_told(index), CURSOR, "balances").aggregate(lambda _, b: b.df.groupBy(F.floor(F.col("balance") / 100).alias("band")).agg(F.count("*").alias("users")))


# partitions


def _ranges(rows: DataFrame, key: str, n: int) -> list[parts.RangePartition]:
    """n ranges that cover every key of the table; fewer, if it has fewer keys than that, and none for no keys."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    return [] if low is None else parts.by_range(low - 1, high).among(min(n, high - low + 1))


#: Four such ranges of users, by number, in SQL.
_RANGES = "with b as (select min(user_id) - 1 lo, max(user_id) hi, (max(user_id) - min(user_id) + 1) // 4 step from events), p as (select e.*, least(3, (user_id - lo - 1) // step) i, lo, hi, step from events e, b), q as (select *, 'partition:' || (lo + i * step) || '-' || case when i = 3 then hi else lo + (i + 1) * step end as part from p)"


@query("with b as (select min(c_custkey) - 1 lo, max(c_custkey) hi, (max(c_custkey) - min(c_custkey) + 1) // 5 step from customer), r as (select lo + i * step a, case when i = 4 then hi else lo + (i + 1) * step end z from b, range(5) t(i)) select 'partition:' || a || '-' || z as \"partition\", count(c_custkey) n from r left join customer on c_custkey > a and c_custkey <= z group by a, z")
def range_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    return parts.counts(rows, "c_custkey", _ranges(rows, "c_custkey", 5))


_GUID = "concat(substr(m,1,8),'-',substr(m,9,4),'-',substr(m,13,4),'-',substr(m,17,4),'-',substr(m,21,12))"
_GUID_KEY = "concat(substr(g,25,12),substr(g,20,4),substr(g,17,2),substr(g,15,2),substr(g,12,2),substr(g,10,2),substr(g,7,2),substr(g,5,2),substr(g,3,2),substr(g,1,2))"


def _guid_sql() -> str:
    from tidemark.functions.guid import key_of

    some = " union all ".join(f"select '{p.name}' as \"partition\", count(*) filter (where k > '{key_of(p.lower)}' and k <= '{key_of(p.upper)}') n from t" for p in parts.all_guids().among(8))
    return f"with t as (select {_GUID_KEY} k from (select {_GUID} g from (select md5(cast(c_custkey as varchar)) m from customer))) {some}"


@query(_guid_sql())
def guid_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("m")).select(F.expr(_GUID).alias("guid"))
    return parts.counts(rows, "guid", parts.all_guids().among(8))


@query("select case when c_name <= 'Customer#000000500' then 'low' else 'high' end as part, count(*) n, min(c_name) first_name, max(c_name) last_name from customer where c_name > 'Customer#000000100' and c_name <= 'Customer#000000900' group by 1")
def string_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = parts.by_range("Customer#000000100", "Customer#000000500"), parts.by_range("Customer#000000500", "Customer#000000900")
    rows = parts.distribute_into(_table(spark, sf_dir, "customer"), "c_name", [low, high])
    named = rows.withColumn("part", F.when(F.col("partition") == low.name, "low").otherwise("high"))
    return named.groupBy("part").agg(F.count("*").alias("n"), F.min("c_name").alias("first_name"), F.max("c_name").alias("last_name"))


@query("select event_id, user_id, value from events where event_type = 'signup' and event_id > 100 order by event_id limit 200")
def value_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = as_stream(_events(spark, sf_dir), "event_id").partitioned("event_type").get(parts.by_value("signup"))
    return made.fetch(Cursor(100), 200).df.select("event_id", "user_id", "value")


@query("select 'partition:' || case when user_id % 3 = 0 then 'zero' when user_id % 3 = 1 then 'one' else 'two' end as \"partition\", count(*) n, max(event_id) cursor_position from events group by 1")
def predicate_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [parts.where(lambda k, i=i: k % 3 == i, name) for i, name in enumerate(("zero", "one", "two"))]
    return parts.distribute_into(_events(spark, sf_dir), "user_id", each).groupBy("partition").agg(F.count("*").alias("n"), F.max("event_id").alias(CURSOR))


@query("select 'partition:0-50' as \"partition\", count(*) filter (where c_custkey > 0 and c_custkey <= 50) n from customer union all select 'partition:25-75', count(*) filter (where c_custkey > 25 and c_custkey <= 75) from customer union all select 'partition:-9--5', 0 from (select 1)")
def distribute_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and empty partitions keep their rows and their zero."""
    return parts.counts(_table(spark, sf_dir, "customer"), "c_custkey", [parts.by_range(0, 50), parts.by_range(25, 75), parts.by_range(-9, -5)])


@query(_RANGES + " select part as \"partition\", max(event_id) cursor_position, count(*) n from q group by part")
def distributed_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per user, caught up partition by partition under leases, with each partition's position in a cursor store."""
    rows, store = _events(spark, sf_dir), ParquetStore(spark, shared_folder(spark, "distributed"))
    cursors, each = CursorStore(spark, store), _ranges(rows, "user_id", 4)
    run = PartitionedCatchup(as_stream(rows, "event_id", "events").partitioned("user_id"), each, rows.count() // 6 + 1, cursors=cursors)
    run.subscribe(Fold(("user_id",), {"n": (F.count("*"), "sum")}, "event_id"), store, "counts")
    distributor = lease.for_partitions(each, workers=4)
    distributor.on_receive(run.receive_all)
    distributor.distribute_all()
    told = [store.get(f"counts-{i}").agg(F.sum("n").alias("n")).select(F.lit(name).alias("partition"), F.lit(cursors.get(f"events/{name}", f"counts-{i}")).alias(CURSOR), "n") for i, name in enumerate(run.parts)]
    return functools.reduce(DataFrame.union, told)


@query(_RANGES + f" select part as \"partition\", user_id, cast(sum({_CHANGE_SQL}) as double) balance, max(event_id) cursor_position from q group by part, user_id")
def distributed_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of changed users, one for each partition, each driving the balances of its users under a lease."""
    rows, store = _events(spark, sf_dir), ParquetStore(spark, shared_folder(spark, "distributed"))
    each, size = _ranges(rows, "user_id", 4), rows.count() // 6 + 1
    run = PartitionedCatchup(as_stream(rows, "event_id", "changes").partitioned("user_id"), each, keyed=lambda s: KeyedCatchup(s, s.rows, "user_id", batch_size=size))
    run.subscribe(balance_fold(), store, "balances")
    distributor = lease.for_partitions(each, workers=4)
    distributor.on_receive(run.receive_all)
    distributor.distribute_all()
    told = [_told(store.get(f"balances-{i}")).withColumn("partition", F.lit(name)) for i, name in enumerate(run.parts)]
    return functools.reduce(DataFrame.union, told)


@query("select i, user_id, event_id from (select case when user_id % 2 = 0 then 'even' else 'odd' end i, *, row_number() over (partition by user_id % 2 order by event_id) p from events where event_id > 99) where p <= 150 and event_type = 'click'")
def partitioned_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's own batch of 150, filtered and expanded into the rows of its keys."""
    rows, told = _events(spark, sf_dir), []
    clicks = as_stream(rows, "event_id").partitioned("user_id").into_many(as_stream(rows, "event_id"), "user_id").map(lambda df: df.where("event_type = 'click'")).trace(lambda at, n: told.append(at), lambda b: told.append(b.count))
    each = {name: clicks.get(parts.where(lambda k, i=i: k % 2 == i, name)).fetch(Cursor(99), 150).df for i, name in enumerate(("even", "odd"))}
    return functools.reduce(DataFrame.union, [df.select(F.lit(name).alias("i"), "user_id", "event_id") for name, df in each.items()])


# folds and state


@query(_BALANCE_SQL)
def projection_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's balance and cursor, on demand."""
    return _told(as_stream(_events(spark, sf_dir), "event_id").aggregate(balance_fold()))


@query(_BALANCE_SQL)
def projection_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State up to event 5000, then only newer rows merged into it."""
    rows, fold = _events(spark, sf_dir), balance_fold()
    state = fold.delta(rows.where("event_id <= 5000"))
    return _told(as_stream(rows, "event_id").aggregate(fold, state, Cursor(5000)))


@query("select user_id, array_to_string(list_sort(list(distinct event_type)), ',') kinds, max(event_id) cursor_position from events group by user_id")
def projection_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    fold = Fold(("user_id",), {"kinds": (F.collect_set("event_type"), "set")}, "event_id")
    state = fold(fold.delta(rows.where("event_id < 700")), as_stream(rows, "event_id").fetch(Cursor(699), None))
    return state.select("user_id", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), CURSOR)


@query("select user_id, count(*) n, arg_max(event_type, event_id) last_kind from events group by user_id")
def projection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in order of events, folded in two batches."""
    rows = _events(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    fold = Fold(("user_id",), {"kinds": (ordered, "list")}, "event_id")
    state = fold(fold.delta(rows.where("event_id < 700")), as_stream(rows, "event_id").fetch(Cursor(699), None))
    return state.select("user_id", F.size("kinds").cast("long").alias("n"), F.element_at("kinds", -1).alias("last_kind"))


@query("with p as (select *, row_number() over (order by event_id) > (select count(*) // 2 from events) late from events), b as (select user_id, late, count(*) n, max(event_id) c from p group by 1, 2) select user_id, arg_max(n, late) n, max(c) cursor_position from b group by user_id")
def projection_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows in the last batch that a user was in, of two halves."""
    rows, at = _events(spark, sf_dir), Cursor()
    fold, stream = Fold(("user_id",), {"n": (F.count("*"), "replace")}, "event_id"), as_stream(rows, "event_id")
    return fold(fold(None, stream.fetch(at, rows.count() // 2)), stream.fetch(at, None)).select("user_id", "n", CURSOR)


@query(_BALANCE_SQL.replace("balance,", "balance, 'audited' note,"))
def pipeline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold within middleware that lets only money through and marks what comes out."""

    def money_only(state: DataFrame | None, batch: Batch, go) -> DataFrame:
        return go(state, Batch(batch.df.withColumn("value", F.when(F.col("event_type").isin("purchase", "error"), F.col("value"))), batch.starts_at, batch.ends_at, batch.count))

    def mark(state: DataFrame | None, batch: Batch, go) -> DataFrame:
        return go(state, batch).withColumn("note", F.lit("audited"))

    state = as_stream(_events(spark, sf_dir), "event_id").aggregate(pipeline(balance_fold(), money_only, mark))
    return state.select("user_id", F.col("balance").cast("double").alias("balance"), "note", CURSOR)


# catching up


@query("select cast((p - 1) // 1000 as bigint) batch, max(event_id) cursor_position, count(*) n, cast(sum(count(*)) over (order by (p - 1) // 1000) as bigint) total from (select event_id, row_number() over (order by event_id) p from events) group by (p - 1) // 1000")
def batch_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor, size and running total after each batch of 1000: what a catch-up goes through, in one job."""
    rows = numbered(_events(spark, sf_dir).select("event_id"), ["event_id"]).withColumn("batch", F.floor((F.col("position") - 1) / 1000))
    return rows.groupBy("batch").agg(F.max("event_id").alias(CURSOR), F.count("*").alias("n"), F.max("position").alias("total"))


@query("select user_id, count(distinct (p - 1) // (select count(*) // 4 + 1 from events)) batches, max(event_id) cursor_position from (select user_id, event_id, row_number() over (order by event_id) p from events) group by user_id")
def batch_count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of four batches each user was in: a fold that adds one a batch, whatever the batch holds."""
    rows, store = _events(spark, sf_dir), MemoryStore()
    run = Catchup(as_stream(rows, "event_id"), batch_size=rows.count() // 4 + 1)
    run.subscribe(Fold(("user_id",), {"batches": (F.max(F.lit(1)).cast("long"), "sum")}, "event_id"), store, "batches")
    run.run_until_caught_up()
    return store.get("batches").select("user_id", "batches", CURSOR)


@query("select event_id, user_id from events where event_id > 300 order by event_id limit 200")
def min_cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subscribers at 300 and 400: the shared fetch starts at 300."""
    at = min_or_default([Cursor(400), Cursor(300)])
    return as_stream(_events(spark, sf_dir), "event_id").fetch(at, 200).df.select("event_id", "user_id")


@query("select event_id, user_id from events where event_id > 400 and event_id <= 500")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the subscriber at 400 folds of the batch (300, 500]."""
    batch = as_stream(_events(spark, sf_dir), "event_id").fetch(Cursor(300), 200)
    return batch.prune("event_id", Cursor(400)).df.select("event_id", "user_id")


@query("with k as (select user_id, max(event_id) m from (select * from events order by event_id limit 400) group by user_id order by m limit 20) select e.user_id, count(*) n from events e join k on k.user_id = e.user_id group by e.user_id")
def multi_upstream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the keys that changed in the first batch of 400 events, the 20 that changed first are folded, with all their events."""
    rows = _events(spark, sf_dir)
    heads = as_stream(event_store.change_feed(rows, "user_id").fetch(n=400).df, "last", "heads")
    made = heads.into_many(as_stream(rows, "event_id"), "user_id", bounded=False)
    return made.fetch(n=20).df.groupBy("user_id").agg(F.count("*").alias("n"))


@query("select event_id, user_id from events where event_id > 700 and user_id <= 30 order by event_id limit 40")
def stream_delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose query asks another stream for the same batch."""
    inner = as_stream(_events(spark, sf_dir).where("user_id <= 30"), "event_id", "inner")
    outer = create("outer", lambda position, n: inner.fetch(Cursor(position), n).df, lambda rows, position: rows.agg(F.max("event_id")).first()[0])
    return outer.fetch(Cursor(700), 40).df.select("event_id", "user_id")


@query("select user_id, event_id, part from (select user_id, event_id, 'old' as part from (select * from events order by event_id limit 30) union all select user_id, event_id, 'new' from (select * from events order by event_id desc limit 20))")
def concat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches side by side; the second is the newest rows, by a descending cursor expression."""
    rows = _events(spark, sf_dir)
    old, new = as_stream(rows, "event_id").fetch(n=30).df, as_stream(rows, -F.col("event_id")).fetch(n=20).df
    return old.select("user_id", "event_id", F.lit("old").alias("part")).unionByName(new.select("user_id", "event_id", F.lit("new").alias("part")))


@query(_BALANCE_SQL)
def catchup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catch-up in batches of a third of the events, saved in a Parquet store after each."""
    rows = _events(spark, sf_dir)
    store = ParquetStore(spark, shared_folder(spark, "catchup"))
    run = Catchup(as_stream(rows, "event_id"), batch_size=rows.count() // 3 + 1)
    run.subscribe(balance_fold(), store, "balance")
    run.run_until_caught_up()
    return _told(store.get("balance"))


@query(_BALANCE_SQL)
def catchup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of changed users drives one job for the unread events of all of them, twice."""
    rows = _events(spark, sf_dir)
    store = ParquetStore(spark, shared_folder(spark, "keys"))
    run = KeyedCatchup(as_stream(rows, "event_id", "changes"), lambda: rows, "user_id", batch_size=rows.count() // 2 + 1)
    run.subscribe(balance_fold(), store, "balance")
    run.run_until_caught_up()
    return _told(store.get("balance"))


@query("with p as (select *, row_number() over (order by event_id) > (select count(*) // 2 from events) late from events) select user_id, count(*) filter (where not late or user_id % 5 <> 0) n, coalesce(max(case when not late or user_id % 5 <> 0 then event_id end), -1) cursor_position, (user_id % 5 = 0 and bool_or(late)) failed from p group by user_id")
def error_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose fold raises, on the second of two halves, keep their state and cursor; the others go on."""
    rows, at = _events(spark, sf_dir).select("event_id", "user_id"), Cursor()
    stream = as_stream(rows, "event_id")
    first = stream.fetch(at, rows.count() // 2)
    half = first.ends_at

    def fold(key, old, new):
        last = new["event_id"][-1].as_py()
        if (key[0] is None or key[0] % 5 == 0) and (half is None or last > half):
            raise ValueError("refused")
        return [(key[0], len(new) + (old["n"][0].as_py() if len(old) else 0), last)]

    step = PythonFold(("user_id",), fold, "user_id long, n long, cursor_position long", "event_id", arrow=True)
    state, failed = step(step(None, first), stream.fetch(at, None)), F.col("error").isNotNull()
    # as in SQL, where it isn't known whether no user is among those refused
    return state.select("user_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(CURSOR, F.lit(-1)).alias(CURSOR), F.when(~(failed & F.col("user_id").isNull()), failed).alias("failed"))


@query("with p as (select event_id, row_number() over (order by event_id) > (select count(*) // 2 from events) late from events) select 'good' subscriber, max(event_id) cursor_position, count(*) n from p union all select 'refusing', max(event_id) filter (where not late), count(*) filter (where not late) from p")
def catchup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subscribers of one catch-up; the one that raises on the second batch, and says to go on, keeps state and cursor."""
    rows, store, failures = _events(spark, sf_dir), ParquetStore(spark, shared_folder(spark, "errors")), []
    fold = Fold(("user_id",), {"n": (F.count("*"), "sum")}, "event_id")
    run = Catchup(as_stream(rows, "event_id"), batch_size=rows.count() // 2)

    def refusing(state: DataFrame | None, batch: Batch) -> DataFrame:
        if state is not None:
            raise ValueError("refused")
        return fold(state, batch)

    run.subscribe(fold, store, "good")
    run.subscribe(refusing, store, "refusing", on_error=lambda f: (failures.append(f), f.go_on()))
    run.run_until_caught_up()
    told = [store.get(s.name).agg(F.sum("n").alias("n")).select(F.lit(s.name).alias("subscriber"), F.lit(s.cursor.position).alias(CURSOR), "n") for s in run.subscribers]
    return told[0].union(told[1])


@query("with p as (select event_id, row_number() over (order by event_id) <= (select count(*) // 2 from events) first_half from events) select 1 run, max(event_id) filter (where first_half) cursor_position, count(*) filter (where first_half) n from p union all select 2, max(event_id), count(*) filter (where not first_half) from p")
def cursor_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side effects on batches whose position a cursor store keeps: a second catch-up goes on where the first stopped."""
    rows, told = _events(spark, sf_dir), []
    cursors = CursorStore(spark, ParquetStore(spark, shared_folder(spark, "cursors")))
    for i, size in ((1, rows.count() // 2), (2, None)):
        run = Catchup(as_stream(rows, "event_id", "events"), batch_size=size, cursors=cursors)
        run.subscribe(name="effects", act=lambda b, i=i: told.append((i, b.df.count())))
        run.run_single_batch()
        told[-1] = (i, cursors.get("events", "effects"), told[-1][1])
    return spark.createDataFrame(told, "run int, cursor_position long, n long")


@query("select row_number() over (order by n_name desc) grant_number, n_name from nation")
def lease_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of named resources, all granted and given back from the last name to the first: the next grants follow that order."""
    pool = lease.MemoryPool(r[0] for r in _table(spark, sf_dir, "nation").select("n_name").collect())
    held = sorted((pool.acquire(60) for _ in pool.resources()), key=lambda x: x.resource, reverse=True)
    assert pool.acquire(60) is None
    for x in held:
        pool.release(x)
    return spark.createDataFrame([(i + 1, pool.acquire(60).resource) for i in range(len(held))], "grant_number long, n_name string")


@query(_BALANCE_SQL)
def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balances as a Structured Streaming query over the files keeps them."""
    folder = shared_folder(spark, "live")
    rows = spark.readStream.schema(_events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern: the source takes no path of a single file
    store = ParquetStore(spark, f"{folder}/state")
    fold_stream(rows, Fold(("user_id",), balance_fold().values, "event_id", prune=False), store, "balance", "event_id", f"{folder}/checkpoint").awaitTermination()
    return _told(store.get("balance"))
