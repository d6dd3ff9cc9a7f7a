"""Connected components of an edge table: alternating star contractions, each round written to the shared folder.

A table of at most ``small`` edges (counted once it is written) is resolved by union-find in one task instead, as a round of contractions costs ten exchanges
whatever its size. That is a choice of plan only, with the same result; the task holds two nodes an edge at most, 150 MB of Python for SMALL edges of 16-byte keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from attestor import scratch


SMALL = 500_000


def _union_find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "component": [find(n) for n in nodes]}, dtype=object)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node sends its larger neighbours to its least one; small: each node sends itself and its smaller neighbours there."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = near.where("b < a").join(least, "a")
        moved = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.where("m < a").select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50, small: int = SMALL) -> DataFrame:
    """Nodes (node, component) of edges (a, b); a component is named by its least node. Nodes without edges aren't listed."""
    now, before = scratch.cut(edges.where("a <> b").select("a", "b").distinct(), "edges"), None
    if now.count() <= small:
        kind = now.schema["a"].dataType.simpleString()
        found = scratch.cut(now.coalesce(1).mapInPandas(_union_find, f"node {kind}, component {kind}"), "components")
        scratch.drop(now)
        return found
    for _ in range(max_rounds):
        after = scratch.cut(_stars(_stars(now, True), False), "edges")
        scratch.drop(now)
        now = after
        # settled when a round leaves the edges as they were; told by their number and sums of two hashes
        state = tuple(now.agg(F.count("*"), *(F.sum(F.shiftright(F.xxhash64(F.lit(i), "a", "b"), 24)) for i in (1, 2))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
