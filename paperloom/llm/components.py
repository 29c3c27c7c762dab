"""Connected components of a table of links, by alternating large and small stars, with a union-find in each task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, hot_join


class UnionFind:
    """Groups of keys; the smallest key of a group is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace links by (key, root) of their components, a run of rows at a time, so that memory is bounded."""
    for part in parts:
        own = UnionFind()
        for a, b in zip(part.a.tolist(), part.b.tolist(), strict=True):
            own.union(a, b)
        keys = [x for x in own.parent if own.find(x) != x]
        yield pd.DataFrame({"a": keys, "b": [own.find(x) for x in keys]}, dtype="int64")


#: Links of a partition, so that small tables don't leave a file for each shuffle partition in every round.
PART_LINKS = 50_000


def _star(links: DataFrame, large: bool, parts: int) -> DataFrame:
    """Link each key's larger neighbours (large) or its smaller ones and itself (small) to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = side.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"), "__n")
        out = hot_join(both, least, ["a"], "__n", parts=parts).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hot_join(side, least, ["a"], "__n", parts=parts).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every key that occurs in the links (a, b): the smallest key that it is linked with."""
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = cut(links.mapInPandas(_forest, "a long, b long").distinct())
    seen = None
    for _ in range(most_rounds):
        mark = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        parts = -(-mark["n"] // PART_LINKS)
        for large in (True, False):  # each star's links are read several times
            links = cut(_star(links.coalesce(parts), large, parts).coalesce(parts))
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
