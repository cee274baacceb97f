from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.cursor import Cursor
from tidemark.operators import partition as parts
from tidemark.operators import stream
from tidemark.operators.stream import as_sequential_stream, as_stream, create, numbered, of


def ints(spark, n, low=1):
    return spark.range(low, n + 1).withColumnRenamed("id", "value")


def values(batch, column="value"):
    return sorted(r[0] for r in batch.df.select(column).collect())


@pytest.mark.parametrize("start,n,size,first,last", [(None, 20, 5, 1, 5), (None, 20, 25, 1, 20), (10, 20, 100, 11, 20), (0, 20, 5, 1, 5)])
def test_fetch_reads_on_from_the_cursor(spark, start, n, size, first, last):
    at = Cursor(start)
    batch = as_stream(ints(spark, n), "value").fetch(at, size)
    assert values(batch) == list(range(first, last + 1))
    assert (batch.starts_at, batch.ends_at, batch.count, at.position) == (start, last, last - first + 1, last)


def test_batches_follow_each_other(spark):
    stream, at = as_stream(ints(spark, 25), "value"), Cursor(5)
    assert [values(stream.fetch(at, 5)) for _ in range(2)] == [[6, 7, 8, 9, 10], [11, 12, 13, 14, 15]]
    at = Cursor(25)
    empty = stream.fetch(at, 5)
    assert empty.is_empty and at.position == 25 and empty.df.count() == 0


def test_default_batch_is_a_thousand(spark):
    assert as_stream(ints(spark, 1500), "value").fetch().count == 1000


def test_times_and_texts_are_cursors(spark):
    start = datetime(2014, 12, 29)
    hours = spark.createDataFrame([(start + timedelta(hours=i),) for i in range(24)], "t timestamp_ntz")
    stream, at = as_stream(hours, "t"), Cursor()
    assert [stream.fetch(at, 12).count for _ in range(3)] == [12, 12, 0]
    letters = spark.createDataFrame([(chr(97 + i),) for i in range(26)], "value string")
    stream, at = as_stream(letters, "value"), Cursor()
    stream.fetch(at, 13)
    assert at.position == "m"
    assert values(stream.fetch(Cursor("j"), 5)) == list("klmno")


def test_equal_cursor_values_are_not_parted_and_nulls_not_read(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,), (None,)], "value int")
    stream, at = as_stream(df, "value"), Cursor()
    first, second = stream.fetch(at, 2), stream.fetch(at, 2)
    assert (values(first), first.count) == ([1, 2, 2, 2], 4)
    assert values(second) == [3]


def test_sequential_streams_advance_by_rows(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "value string").repartition(3)
    stream, at = as_sequential_stream(df, ["value"]), Cursor(0)
    assert values(stream.fetch(at, 3)) == ["a", "b", "c"] and at.position == 3
    assert values(stream.fetch(at, 3)) == ["d"]


def test_map_keeps_the_sources_cursor(spark):
    at = Cursor()
    batch = as_stream(ints(spark, 9), "value").filter(F.col("value") > 100).fetch(at, 9)
    assert batch.df.count() == 0 and batch.count == 9 and at.position == 9


def test_into_many_is_bounded_by_the_upstream_batch(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(1, 31)], "id int, key int")
    up = as_stream(df, "id")
    batch = up.into_many(up, "key").fetch(Cursor(10), 2)
    assert values(batch, "id") == [11, 12]
    assert len(values(up.into_many(up, "key", bounded=False).fetch(Cursor(10), 1), "id")) == 10


def test_partitions_have_cursors_of_their_own(spark):
    made = as_stream(ints(spark, 1000), "value").partitioned("value")
    ends = []
    for p in parts.by_range(0, 1000).among(2):
        at = Cursor()
        assert made.get(p).fetch(at, None).count == 500
        ends.append(at.position)
    assert ends == [500, 1000]


def test_partition_predicates_reach_the_scan(spark, tmp_path):
    ints(spark, 100).write.parquet(str(tmp_path / "t"))
    df = parts.within(spark.read.parquet(str(tmp_path / "t")), "value", parts.by_range(10, 20))
    assert "GreaterThan(value,10)" in df._jdf.queryExecution().toString()
    assert df.count() == 10


def test_distribution_keeps_overlaps_and_empty_parts(spark):
    each = [parts.by_range(0, 6), parts.by_range(4, 10), parts.by_value(99), parts.where(lambda k: k % 2 == 0, "even", lambda v: v % 2 == 0)]
    rows = {r["partition"]: r["n"] for r in parts.counts(ints(spark, 10), "value", each).collect()}
    assert list(rows.values()) == [6, 6, 0, 5]
    assert parts.distribute_into(ints(spark, 10), "value", each).count() == 17
    assert each[3].contains(4) and each[2].contains(99)


def test_guid_partitions_agree_with_single_tests(spark):
    df = spark.range(500).select(F.expr("concat(substr(md5(string(id)),1,8),'-',substr(md5(string(id)),9,4),'-',substr(md5(string(id)),13,4),'-',substr(md5(string(id)),17,4),'-',substr(md5(string(id)),21,12))").alias("g"))
    each = parts.all_guids().among(5)
    got = {r["partition"]: r["n"] for r in parts.counts(df, "g", each).collect()}
    all_ = [r[0] for r in df.collect()]
    assert got == {p.name: sum(p.contains(g) for g in all_) for p in each}
    assert sum(got.values()) == 500


def test_trace_and_builder(spark):
    told = []
    stream = of("x").named("y").cursor("value", 2).batches_of(3).create(lambda: ints(spark, 9))
    stream = stream.trace(lambda at, n: told.append((at, n)), lambda b: told.append(b.count))
    assert values(stream.fetch()) == [3, 4, 5] and told == [(2, 3), 3] and stream.id == "y"
    with pytest.raises(ValueError):
        of("x").create(lambda: None)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_gapless_over_many_files_of_wide_rows(spark, tmp_path, adaptive):
    n = 60_000
    wide = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("pad"))
    wide.repartition(12).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= 8 or spark.sparkContext.defaultParallelism < 8
        made = numbered(df, ["k"])
        ends = made.agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position"), F.countDistinct("pad")).first()
        assert tuple(ends) == (n, n, 1, n, n)
        want = [r[0] for r in df.select("k").orderBy("k").collect()]
        assert [r[0] for r in made.orderBy("position").select("k").collect()] == want
        stream, at = as_sequential_stream(df.select("k"), ["k"]), Cursor(29_990)
        assert values(stream.fetch(at, 20), "k") == want[29_990:30_010] and at.position == 30_010
        assert values(stream.fetch(Cursor(n - 5), 20), "k") == want[-5:]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_an_empty_sequence_has_no_rows(spark):
    df = spark.createDataFrame([], "k long, position_of string")
    assert numbered(df, ["k"]).count() == 0
    assert as_sequential_stream(df, ["k"]).fetch(n=5).is_empty


def test_a_query_of_ones_own_sees_position_and_size_and_says_where_it_ends(spark):
    asked = []

    def query(position, n):
        asked.append((position, n))
        return ints(spark, 100).where(f"value > {2 * position}").orderBy("value").limit(n)

    stream, at = create("own", query, lambda rows, position: position + rows.count(), 0, 3), Cursor(0)
    assert [values(stream.fetch(at)) for _ in range(2)] == [[1, 2, 3], [7, 8, 9]]
    assert asked == [(0, 3), (3, 3)] and at.position == 6
    built = of("x").advance(lambda rows, position: 50, 4).batches_of(2).create(query)
    batch = built.fetch()
    assert (values(batch), batch.starts_at, batch.ends_at) == ([9, 10], 4, 50)
    halves = create("own", query, lambda rows, position: 1, 0).within("value", parts.by_range(0, 2))
    assert values(halves.fetch(n=9)) == [1, 2]


def test_cursors_can_be_expressions(spark):
    stream, at = as_stream(ints(spark, 10), -F.col("value")), Cursor()
    assert [values(stream.fetch(at, 4)) for _ in range(3)] == [[7, 8, 9, 10], [3, 4, 5, 6], [1, 2]]
    assert at.position == -1


def test_null_keys_are_keys_of_their_own(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "id int, key string")
    up = as_stream(df, "id")
    assert values(up.into_many(up, "key").fetch(n=2), "id") == [1, 2]
    assert values(up.into_many(up, "key", bounded=False).fetch(n=2), "id") == [1, 2, 4]


@pytest.mark.parametrize("values", [list(range(3000)), [i % 6 for i in range(2000)], [7] * 500, [5] * 1500 + list(range(500))], ids=["distinct", "ties", "one", "mostly one"])
def test_no_task_holds_a_large_batch_to_find_its_end(spark, monkeypatch, values):
    df, taken = spark.createDataFrame([(v,) for v in values], "id long").repartition(5).cache(), []
    monkeypatch.setattr(stream, "TOP_N", 50, raising=False)
    limit = type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: (taken.append(n), limit(self, n))[1])
    for n in (60, len(values) // 2, len(values), len(values) + 9):
        batch, last = stream.as_stream(df, "id").fetch(n=n), sorted(values)[: n][-1]
        assert (batch.ends_at, batch.count) == (last, sum(v <= last for v in values))
    assert all(n <= 50 for n in taken)
