"""Text guids in the order of SQL Server's uniqueidentifier, as sortable hexadecimal keys and as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the groups of hexadecimal digits of a canonical guid (1-based start, length) stand in the sort key.
_ORDER = ((25, 12), (20, 4), (17, 2), (15, 2), (12, 2), (10, 2), (7, 2), (5, 2), (3, 2), (1, 2))
LAST = (1 << 128) - 1


def guid_key(guid: Column) -> Column:
    """32 hexadecimal digits that sort, as text, as the guids do; null for null."""
    g = F.lower(guid)
    return F.concat(*(F.substring(g, at, n) for at, n in _ORDER))


def key_of(guid: str) -> str:
    """guid_key() of one guid."""
    g = guid.lower()
    return "".join(g[at - 1 : at - 1 + n] for at, n in _ORDER)


def to_int(guid: str) -> int:
    """A guid's place in the order, from 0 to 2**128 - 1."""
    return int(key_of(guid), 16)


def from_int(place: int) -> str:
    """The guid at a place."""
    key, out, at = f"{place:032x}", [""] * 36, 0
    for start, n in _ORDER:
        out[start - 1 : start - 1 + n] = key[at : at + n]
        at += n
    for dash in (8, 13, 18, 23):
        out[dash] = "-"
    return "".join(out)
