"""Partitions of a stream: ranges, single values and predicates as boolean columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import guid


@dataclass(frozen=True)
class Partition:
    """A named part of all keys."""

    name: str

    def predicate(self, key: Column) -> Column:
        """True for keys inside."""
        raise NotImplementedError

    def contains(self, value: Any) -> bool:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class RangePartition(Partition):
    """Keys above lower, up to and with upper; without a lower bound, all up to upper."""

    lower: Any
    upper: Any
    guids: bool = False

    def predicate(self, key: Column) -> Column:
        key = guid.guid_key(key) if self.guids else key
        low, high = (guid.key_of(x) if self.guids and x is not None else x for x in (self.lower, self.upper))
        return key <= F.lit(high) if low is None else (key > F.lit(low)) & (key <= F.lit(high))

    def contains(self, value: Any) -> bool:
        rank = guid.to_int if self.guids else lambda x: x
        return (self.lower is None or rank(value) > rank(self.lower)) and rank(value) <= rank(self.upper)

    def among(self, n: int) -> list[RangePartition]:
        """n gapless parts of equal integer width; the last takes the remainder. Text ranges can't be split."""
        if self.lower is None:
            raise TypeError("a range without a lower bound can't be split")
        if self.guids:
            ends = [guid.from_int(x) for x in _ends(guid.to_int(self.lower), guid.to_int(self.upper), n)]
        elif isinstance(self.lower, int) and isinstance(self.upper, int):
            ends = _ends(self.lower, self.upper, n)
        else:
            raise TypeError(f"ranges of {type(self.lower).__name__} can't be split")
        return [by_range(a, b, guids=self.guids) for a, b in zip([self.lower, *ends], [*ends, self.upper])]


def _ends(low: int, high: int, n: int) -> list[int]:
    step = (high - low) // n
    return [low + step * i for i in range(1, n)]


@dataclass(frozen=True)
class ValuePartition(Partition):
    """One key."""

    value: Any

    def predicate(self, key: Column) -> Column:
        return key == F.lit(self.value)

    def contains(self, value: Any) -> bool:
        return value == self.value


@dataclass(frozen=True)
class PredicatePartition(Partition):
    """Keys for which a column expression is true; test, if given, says the same of one value."""

    expression: Callable[[Column], Column]
    test: Callable[[Any], bool] | None = field(default=None, compare=False)

    def predicate(self, key: Column) -> Column:
        return self.expression(key)

    def contains(self, value: Any) -> bool:
        if self.test is None:
            raise TypeError(f"partition {self.name} has no test for single values")
        return self.test(value)


def by_range(lower: Any, upper: Any, guids: bool = False) -> RangePartition:
    """Keys in (lower, upper]; lower must be less than upper. Text is in binary order."""
    rank = guid.to_int if guids else lambda x: x
    if lower is not None and not rank(lower) < rank(upper):
        raise ValueError(f"the lower bound {lower!r} must be less than the upper bound {upper!r}")
    return RangePartition(f"partition:{lower}-{upper}", lower, upper, guids)


def by_value(value: Any) -> ValuePartition:
    return ValuePartition(f"partition:{value}", value)


def where(expression: Callable[[Column], Column], name: str, test: Callable[[Any], bool] | None = None) -> PredicatePartition:
    return PredicatePartition(f"partition:{name}", expression, test)


def all_guids() -> RangePartition:
    """All guids but the one of zeros, which the exclusive lower bound leaves out."""
    return by_range(guid.from_int(0), guid.from_int(guid.LAST), guids=True)


def within(df: DataFrame, key: str | Column, partition: Partition) -> DataFrame:
    """Rows whose key is inside; ranges and values of plain columns reach the scan as pushed filters."""
    return df.where(partition.predicate(F.col(key) if isinstance(key, str) else key))


def distribute_into(df: DataFrame, key: str, partitions: Iterable[Partition]) -> DataFrame:
    """df's rows with the name of each partition that holds them in `partition`: one pass, a row for each of them.

    Rows in no partition are left out; rows in overlapping ones come once for each.
    """
    names = F.array(*(F.when(p.predicate(F.col(key)), F.lit(p.name)) for p in partitions))
    return df.withColumn("partition", F.explode(F.array_compact(names)))


def counts(df: DataFrame, key: str, partitions: list[Partition]) -> DataFrame:
    """partition, n: rows of each partition, empty ones with 0, from one aggregation without grouping keys."""
    each = df.agg(*(F.count(F.when(p.predicate(F.col(key)), 1)).alias(f"n{i}") for i, p in enumerate(partitions)))
    pairs = F.array(*(F.struct(F.lit(p.name).alias("partition"), F.col(f"n{i}").alias("n")) for i, p in enumerate(partitions)))
    return each.select(F.inline(pairs))
