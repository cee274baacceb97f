from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import guid
from tidemark.functions.cursor import Cursor, ReadOnlyCursor, has_reached, min_or_default
from tidemark.operators import partition as parts


def test_cursor_has_reached_what_is_not_beyond_it():
    at = Cursor(5)
    assert at.has_reached(5) and at.has_reached(4) and not at.has_reached(6)
    assert not Cursor().has_reached(0)
    with pytest.raises(TypeError):
        at.has_reached("a")


def test_cursor_moves_both_ways_and_knows_it():
    at = Cursor(5)
    assert not at.was_advanced
    at.advance_to(3)
    assert at.position == 3 and at.was_advanced
    with pytest.raises(RuntimeError):
        ReadOnlyCursor(1).advance_to(2)
    assert has_reached(0) and has_reached(-1, ascending=False) and not has_reached(-1)


def test_min_cursor_is_a_copy_of_the_one_furthest_behind():
    a, b = Cursor(3), Cursor(7)
    least = min_or_default([b, a])
    assert least.position == 3 and least is not a
    assert min_or_default([a, Cursor()]).position is None
    assert min_or_default([]) is None


def test_ranges_leave_out_their_lower_bound():
    p = parts.by_range(0, 10)
    assert not p.contains(0) and p.contains(10) and not p.contains(11)
    for lo, hi in ((1, 1), (2, 1)):
        with pytest.raises(ValueError):
            parts.by_range(lo, hi)


def test_among_is_gapless_and_the_last_part_takes_the_rest():
    assert [(p.lower, p.upper) for p in parts.by_range(0, 11).among(3)] == [(0, 3), (3, 6), (6, 11)]
    assert [p.upper for p in parts.by_range(0, 100).among(10)] == list(range(10, 101, 10))
    low = -(1 << 31)
    assert parts.by_range(low, -low - 1).among(7)[-1].upper == -low - 1
    with pytest.raises(TypeError):
        parts.by_range("a", "z").among(2)
    with pytest.raises(ValueError):
        parts.by_range(0, 2).among(5)


@given(st.uuids(), st.uuids())
def test_guid_places_round_trip_and_order_like_keys(a, b):
    a, b = str(a), str(b)
    assert guid.from_int(guid.to_int(a)) == a
    assert (guid.to_int(a) < guid.to_int(b)) == (guid.key_of(a) < guid.key_of(b))


@given(st.uuids(), st.integers(1, 50))
def test_every_guid_but_zero_is_in_one_part(g, n):
    inside = [p for p in parts.all_guids().among(n) if p.contains(str(g))]
    assert len(inside) == (g.int != 0)


def test_guid_bytes_count_in_the_servers_order():
    places = ["01000000-0000-0000-0000-000000000000", "00010000-0000-0000-0000-000000000000", "00000000-0100-0000-0000-000000000000", "00000000-0000-0000-0100-000000000000", "00000000-0000-0000-0000-010000000000"]
    assert sorted(places, key=guid.to_int) == places


def test_naive_times_stay_without_zone(spark):
    df = spark.sql("select timestamp_ntz'2020-01-02 00:00:00' as t")
    assert df.where(Cursor(datetime(2020, 1, 1)).unread(df.t)).count() == 1
    assert df.where(Cursor(datetime(2020, 1, 2)).unread(df.t)).count() == 0
