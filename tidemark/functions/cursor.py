"""Positions in ordered data."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cursor:
    """A position that moves forward over ordered values; None stands before all of them."""

    def __init__(self, position: Any = None):
        self.start = self.position = position

    def has_reached(self, point: Any) -> bool:
        """Whether the position is at or beyond point; a fresh cursor has reached nothing."""
        if self.position is None:
            return False
        try:
            return bool(self.position >= point)
        except TypeError as e:
            raise TypeError(f"can't compare a cursor at {self.position!r} with {point!r}") from e

    def advance_to(self, point: Any) -> None:
        """Move to point, also where that is behind; who must not go back compares first."""
        self.position = point

    @property
    def was_advanced(self) -> bool:
        return self.position != self.start

    def clone(self) -> Cursor:
        return Cursor(self.position)

    def unread(self, column: Column) -> Column:
        """True for rows beyond the position."""
        return unread(column, self.position)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.position!r})"


class ReadOnlyCursor(Cursor):
    """A cursor that refuses to move."""

    def advance_to(self, point: Any) -> None:
        raise RuntimeError("this cursor can't be advanced")


def has_reached(comparison: int, ascending: bool = True) -> bool:
    """What a three-way comparison of position and point says in either direction."""
    return comparison >= 0 if ascending else comparison <= 0


def min_or_default(cursors: Iterable[Cursor]) -> Cursor | None:
    """A copy of the cursor furthest behind, one without position before all; None for no cursors."""
    cursors = list(cursors)
    if not cursors:
        return None
    fresh = [c for c in cursors if c.position is None]
    return (fresh[0] if fresh else min(cursors, key=lambda c: c.position)).clone()


def unread(column: Column, position: Any) -> Column:
    """True for rows beyond position, for all rows if it is None."""
    return F.lit(True) if position is None else column > literal(position)


def literal(value: Any) -> Column:
    """A position as a column; times without a zone stay so, and compare with such columns unchanged."""
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    return F.lit(value)
