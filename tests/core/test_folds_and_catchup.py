import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.cursor import Cursor
from tidemark.operators import partition as parts
from tidemark.operators.fold import Fold, PythonFold, pipeline, traced
from tidemark.operators.stream import as_stream
from tidemark.plans.catchup import Catchup, KeyedCatchup, PartitionedCatchup, backoff
from tidemark.plans.lease import for_partitions
from tidemark.plans.store import CallableCursors, CallableStore, CursorStore, MemoryStore, ParquetStore, RetryingStore, TracedStore, retried


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(i, i % 4, i * 0.5, "ab"[i % 2]) for i in range(1, 41)], "id long, key long, value double, kind string").cache()


def fold(keys=("key",), **more):
    return Fold(keys, {"n": (F.count("*"), "sum"), "top": (F.max("value"), "max"), "low": (F.min("value"), "min"), "kinds": (F.array_sort(F.collect_set("kind")), "set"), "ids": (F.array_sort(F.collect_list("id")), "list")}, "id", **more)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [7, 40, None])
def test_batchwise_equals_at_once(spark, events, tmp_path, size):
    store = ParquetStore(spark, str(tmp_path))
    run = Catchup(as_stream(events, "id"), batch_size=size)
    run.subscribe(fold(), store, "s")
    assert run.run_until_caught_up() == 40 and run.rows_seen == 40
    assert rows(store.get("s")) == rows(as_stream(events, "id").aggregate(fold()))


def test_a_new_catchup_goes_on_from_the_stored_cursor(spark, events):
    store, told = MemoryStore(), []
    first = Catchup(as_stream(events.where("id <= 10"), "id"))
    first.subscribe(fold(), store, "s")
    first.run_until_caught_up()
    second = Catchup(as_stream(events, "id").trace(lambda at, n: told.append(at), None))
    second.subscribe(fold(), store, "s")
    assert second.run_single_batch() == 30 and told == [10]
    assert sum(r["n"] for r in store.get("s").collect()) == 40


def test_subscribers_share_a_fetch_and_each_sees_only_its_own_rows(spark, events):
    fetches, ahead, seen = [], MemoryStore(), []
    run = Catchup(as_stream(events.where("id <= 6"), "id"))
    run.subscribe(fold(), ahead, "a")
    run.run_single_batch()
    both = Catchup(as_stream(events, "id").trace(lambda at, n: fetches.append(at), None))
    both.subscribe(fold(), ahead, "a")
    off = both.subscribe(act=lambda b: seen.append(b.df.count()))
    both.run_single_batch()
    assert fetches == [None] and seen == [40]
    assert sum(r["n"] for r in ahead.get("a").collect()) == 40
    off()
    assert len(both.subscribers) == 1


def test_nothing_is_fetched_without_subscribers(events):
    fetches = []
    assert Catchup(as_stream(events, "id").trace(lambda at, n: fetches.append(at), None)).run_single_batch() == 0
    assert not fetches


def test_an_explicit_cursor_wins(events):
    store = MemoryStore()
    run = Catchup(as_stream(events, "id"), Cursor(30), 20)
    run.subscribe(fold(), store, "s")
    assert run.run_single_batch() == 10


def test_a_handled_error_stops_no_one_else_and_an_unhandled_one_leaves_the_gate_open(events):
    good, failures = MemoryStore(), []

    def bad(state, batch):
        raise ValueError("no")

    run = Catchup(as_stream(events, "id"))
    off = run.subscribe(bad, on_error=lambda f: (failures.append(f), f.go_on()))
    run.subscribe(fold(), good, "g")
    run.run_single_batch()
    assert len(failures) == 1 and good.get("g") is not None
    assert run.subscribers[0].cursor.position is None and run.subscribers[1].cursor.position == 40
    off()
    other = Catchup(as_stream(events, "id"))
    other.subscribe(bad)
    for _ in range(2):
        with pytest.raises(ValueError):
            other.run_single_batch()


def test_failing_keys_keep_their_state(events):
    def step(key, old, new):
        if key[0] == 1 and new["id"].max() > 20:
            raise ValueError("no")
        return new.iloc[:1][["key"]].assign(n=len(new) + (int(old["n"].iloc[0]) if len(old) else 0), cursor_position=int(new["id"].max()))

    stream, at = as_stream(events, "id"), Cursor()
    made = PythonFold(("key",), step, "key long, n long, cursor_position long", "id")
    state = made(made(None, stream.fetch(at, 20)), stream.fetch(at, 20))
    got = {r["key"]: (r["n"], r["cursor_position"], r["error"]) for r in state.collect()}
    assert got[1][:2] == (5, 17) and "no" in got[1][2]
    assert all(got[k][0] == 10 and got[k][2] is None for k in (0, 2, 3))


def test_a_fold_of_arrow_rows_keeps_what_failing_keys_had(events):
    def step(key, old, new):
        if key[0] == 1 and new["id"][-1].as_py() > 20:
            raise ValueError("no")
        assert new["id"].to_pylist() == sorted(new["id"].to_pylist())
        n = len(new) + (old["n"][0].as_py() if len(old) else 0)
        return [(key[0], "many" if key[0] == 2 and n > 5 else n, new["id"][-1].as_py())]

    stream, at = as_stream(events, "id"), Cursor()
    made = PythonFold(("key",), step, "key long, n long, cursor_position long", "id", arrow=True)
    state = made(made(None, stream.fetch(at, 20)), stream.fetch(at, 20))
    again = made(state, stream.fetch(Cursor(), None))
    for got in ({r["key"]: (r["n"], r["cursor_position"], r["error"]) for r in s.collect()} for s in (state, again)):
        assert got[1][:2] == (5, 17) and "no" in got[1][2]
        assert got[2][:2] == (5, 18) and "many" in got[2][2]  # not a long
        assert got[0] == (10, 40, None) and got[3] == (10, 39, None)
    with pytest.raises(Exception, match="no"):
        PythonFold(("key",), step, "key long, n long, cursor_position long", "id", "raise", arrow=True)(None, stream.fetch(n=None)).collect()


def test_a_fold_of_arrow_rows_cuts_streams_where_keys_change(spark):
    """Keys that span Arrow batches, null and NaN keys, two zeros, keys of two columns, one of them an array."""
    parts = [(None, 3), (float("nan"), 25), (0.0, 4), (-0.0, 5), (1.5, 61), *((float(i), 1) for i in range(2, 30))]
    data = [(k, ["a", None] if i % 3 else None, None if i % 2 else "x") for k, n in parts for i in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, key double, tags array<string>, value string")
    made = PythonFold(("key", "tags"), lambda key, old, new: [(*key, len(new), new["value"].null_count, new["id"][-1].as_py())], "key double, tags array<string>, n long, nulls long, cursor_position long", "id", arrow=True)
    want = df.groupBy("key", "tags").agg(F.count("*"), F.count("*") - F.count("value"), F.max("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = made(None, as_stream(df, "id").fetch(n=None))
        assert got.where("error is not null").count() == 0
        assert str(rows(got.drop("error"))) == str(rows(want))  # NaN is not equal to itself
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_catch_up_together_and_read_no_row_twice(events, spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    run = KeyedCatchup(as_stream(events, "id"), lambda: events, "key", batch_size=9)
    run.subscribe(fold(), store, "s")
    run.run_until_caught_up()
    assert rows(store.get("s")) == rows(fold().delta(events))


def test_middleware_given_last_is_outermost(events):
    order = []

    def layer(name):
        return lambda state, batch, go: (order.append(name), go(state, batch))[1]

    as_stream(events, "id").aggregate(pipeline(traced(fold(), lambda *_: order.append("fold")), layer("in"), layer("out")))
    assert order == ["out", "in", "fold"]
    short = pipeline(fold(), lambda state, batch, go: state)
    assert as_stream(events, "id").aggregate(short, "kept") == "kept"


def test_partitions_catch_up_apart_under_a_distributor(spark, events):
    each = parts.by_range(0, 40).among(4)
    run = PartitionedCatchup(as_stream(events, "id").partitioned("id"), each)
    run.subscribe(fold(), MemoryStore())
    distributor = for_partitions(each, workers=2)
    distributor.on_receive(run.receive)
    assert distributor.distribute_all() == 4
    assert list(run.cursors().values()) == [10, 20, 30, 40]
    assert set(run.run_single_batch().values()) == {0}


def test_backoff_rests_partitions_without_rows():
    each, calls = parts.by_range(0, 4).among(2), []
    distributor = for_partitions(each, workers=1, wait=0.01)
    distributor.on_receive(backoff(distributor, lambda lease: (calls.append(lease.resource), 0)[1], 60))
    distributor.start()
    time.sleep(0.4)
    distributor.stop()
    assert sorted(calls) == sorted(map(str, each))


def test_stores(spark, tmp_path, events):
    store, told = ParquetStore(spark, str(tmp_path)), []
    state = fold().delta(events)
    assert store.get("x") is None
    store.put("x", state, "1")
    store.put("x", state.limit(0), "1")  # the same batch again
    assert store.get("x").count() == 4
    for i in range(3):
        store.put("x", state, str(i + 2))
    assert sum(p.is_dir() for p in (tmp_path / "x").iterdir()) == 2
    traced_store = TracedStore(store, lambda n, s: told.append("get"), lambda n, s: told.append("put"))
    traced_store.put("y", traced_store.get("x"))
    assert told == ["get", "put"]
    with pytest.raises(ValueError):
        MemoryStore().put("x", None)
    got = []
    CallableStore(lambda n: None, lambda n, s: got.append(n)).put("z", state)
    assert got == ["z"]
    cursors = CursorStore(spark, MemoryStore())
    cursors.put("a", 5, "p")
    cursors.put("a", 7, "p")
    cursors.put("a", "m")
    assert (cursors.get("a", "p"), cursors.get("a"), cursors.get("b")) == (7, "m", None)


def test_poll_runs_until_stopped(events):
    seen = []
    run = Catchup(as_stream(events, "id"), batch_size=15)
    run.subscribe(act=lambda b: seen.append(b.count))
    stop = run.poll(0.01)
    end = time.time() + 60
    while len(seen) < 3 and time.time() < end:
        time.sleep(0.05)
    stop()
    assert seen == [15, 15, 10]


def test_keys_that_are_null_catch_up_like_others(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id long, key string")
    count, store = Fold(("key",), {"n": (F.count("*"), "sum")}, "id"), MemoryStore()
    run = KeyedCatchup(as_stream(df, "id"), lambda: df, "key", batch_size=3)
    run.subscribe(count, store, "s")
    run.run_until_caught_up()
    assert rows(store.get("s")) == [("a", 2, 3), (None, 2, 4)]
    again = count(store.get("s"), as_stream(df, "id").fetch(n=None))
    assert rows(again) == [("a", 2, 3), (None, 2, 4)]


def test_keys_read_from_the_batch_on_but_from_further_back_where_one_failed(spark, events):
    def step(key, old, new):
        if key[0] == 1 and new["id"].max() == 21:
            raise ValueError("no")
        return new.iloc[:1][["key"]].assign(n=len(new) + (int(old["n"].iloc[0]) if len(old) else 0), cursor_position=int(new["id"].max()))

    store, seen = MemoryStore(), []
    run = KeyedCatchup(as_stream(events, "id"), lambda: events, "key", batch_size=12)
    run.subscribe(PythonFold(("key",), step, "key long, n long, cursor_position long", "id"), store, "s")
    run.subscribe(name="act", act=lambda b: seen.append(b.df.agg(F.min("id")).first()[0]))
    for n, of_one, failed in ((12, 3, False), (12, 3, True), (12, 9, False), (4, 10, False)):
        assert run.run_single_batch() == n
        got = {r["key"]: (r["n"], r["error"] is not None) for r in store.get("s").collect()}
        assert got[1] == (of_one, failed) and not got[2][1]
    assert seen == [1, 13, 10, 37]  # the third batch goes back to where key 1 stopped
    assert {k: n for k, (n, _) in got.items()} == dict.fromkeys(range(4), 10)


def test_a_late_subscriber_gets_its_keys_whole_history(spark, events):
    first, late = MemoryStore(), MemoryStore()
    run = KeyedCatchup(as_stream(events, "id"), lambda: events, "key", batch_size=20)
    run.subscribe(fold(), first, "s")
    run.run_single_batch()
    run.subscribe(fold(), late, "s")
    run.run_until_caught_up()
    assert rows(first.get("s")) == rows(late.get("s")) == rows(fold().delta(events))


def test_positions_outlive_a_catchup(spark, events):
    cursors, store, seen = CursorStore(spark, MemoryStore()), MemoryStore(), []
    for _ in range(3):
        run = Catchup(as_stream(events, "id", "e"), batch_size=15, cursors=cursors)
        run.subscribe(name="effects", act=lambda b: seen.append((b.starts_at, b.ends_at)))
        run.run_single_batch()
    assert seen == [(None, 15), (15, 30), (30, 40)]
    for _ in range(2):
        keyed = KeyedCatchup(as_stream(events, "id", "k"), lambda: events, "key", batch_size=20, cursors=cursors)
        keyed.subscribe(fold(), store, "s")
        keyed.run_single_batch()
        assert keyed.subscribers[0].since == keyed.cursor.position
    assert rows(store.get("s")) == rows(fold().delta(events)) and cursors.get("k/all") == 40
    each = parts.by_range(0, 40).among(2)
    for _ in range(2):
        run = PartitionedCatchup(as_stream(events, "id", "p").partitioned("id"), each, 12, cursors=cursors)
        run.subscribe(act=lambda b: None)
        run.run_single_batch()
    assert run.cursors() == {"partition:0-20": 20, "partition:20-40": 40}
    positions = {}
    own = CallableCursors(lambda s, p: positions.get((s, p)), lambda s, at, p: positions.update({(s, p): at}))
    run = Catchup(as_stream(events, "id", "o"), Cursor(), 9, own)
    run.subscribe(act=lambda b: None)
    run.run_single_batch()
    assert positions == {("o", ""): 9, ("o", "o-0/since"): 9}
    cursors.put("t", datetime(2020, 1, 2, 3))
    assert cursors.get("t") == datetime(2020, 1, 2, 3)


def test_a_batch_that_failed_comes_again(events):
    seen, fail = [], [True]

    def act(batch):
        seen.append(batch.starts_at)
        if fail.pop() if fail else False:
            raise ValueError("once")

    run = Catchup(as_stream(events, "id"), Cursor(), 25)
    run.subscribe(act=act)
    with pytest.raises(ValueError):
        run.run_single_batch()
    run.run_until_caught_up()
    assert seen == [None, None, 25]


def test_polling_goes_on_after_an_error_and_tells_of_it(events):
    told, seen, fail = [], [], [True]

    def act(batch):
        if fail:
            fail.pop()
            raise ValueError("once")
        seen.append(batch.count)

    run = Catchup(as_stream(events, "id"), batch_size=None)
    run.subscribe(act=act)
    stop = run.poll(0.01, told.append)
    end = time.time() + 60
    while not seen and time.time() < end:
        time.sleep(0.05)
    stop()
    assert seen == [40] and [str(e) for e in told] == ["once"] and str(run.error) == "once"


def test_catching_up_ends_where_only_a_failing_subscriber_is_behind(events):
    run = Catchup(as_stream(events, "id"), batch_size=20)
    run.subscribe(act=lambda b: 1 / 0, on_error=lambda f: f.go_on())
    run.subscribe(act=lambda b: None)
    assert run.run_until_caught_up(60) >= 20


def test_passing_failures_are_tried_again(spark, events):
    calls = []

    def work():
        calls.append(None)
        if len(calls) < 3:
            raise OSError("passing")
        return "done"

    assert retried(work, pause=0.001) == "done" and len(calls) == 3
    with pytest.raises(ValueError):
        retried(lambda: (_ for _ in ()).throw(ValueError("lasting")), pause=0.001)

    class Shaky(MemoryStore):
        def get(self, name):
            calls.append(name)
            if calls.count(name) == 1:
                raise OSError("passing")
            return super().get(name)

    assert RetryingStore(Shaky(), pause=0.001).get("x") is None
