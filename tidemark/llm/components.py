"""Connected components of a link table: union-find inside each task, then pointer jumping between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept, scratch


class UnionFind:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as (node, root) of its sets; memory follows the nodes of the task."""
    sets = UnionFind()
    for b in parts:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sets.union(x, y)
    nodes = np.fromiter(sets.parent, "i8", len(sets.parent))
    roots = np.fromiter(map(sets.find, sets.parent), "i8", len(sets.parent))
    some = nodes != roots
    yield pa.record_batch([pa.array(nodes[some]), pa.array(roots[some])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node long, component long (the smallest node reachable) of all nodes in links but the smallest of each component.

    links: two columns of longs in either order; loops and repeated links do no harm; links with a null are ignored; an
    empty table gives no rows. Each round keeps, for a node, its smallest root, links its other roots to that one, and
    skips from roots to their roots. A node has at most one root for each task of the first step, and roots that many
    nodes share only stand on the side of a join that Spark splits. Rounds grow with the logarithm of the longest chain
    between tasks; each is a table in the shared folder.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long"), F.col(b).cast("long")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    with scratch() as stay:
        edges = kept(links.mapInArrow(_forest, "node long, root long"))
        while True:
            lowest = kept(edges.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")))
            forked = lowest.where("low <> high").select("node", "low")
            extra = edges.join(forked, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
            up = lowest.select(F.col("node").alias("low"), F.col("low").alias("next"))
            jumped = lowest.select("node", "low").join(up, "low", "left").select("node", F.coalesce("next", "low").alias("component"), F.col("next").isNotNull().alias("moved"))
            made = kept(jumped.unionByName(extra.select("node", F.col("root").alias("component"), F.lit(True).alias("moved"))))
            if not made.where("moved").limit(1).count():
                made = kept(made.select("node", "component"))
                stay.append(made)
                return made
            edges = made.select("node", F.col("component").alias("root"))
