"""Nearest neighbours by Euclidean distance: stable random projections, kd-trees and a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions (at most their own) by Gaussian directions made orthogonal to one another, so squared projected
distance over squared distance follows a chi-square law of DIMS degrees, or one with less spread where DIMS is a large part of the
dimensions: the test then errs on the side of recall. A search takes points in the order of their projected distance and verifies them on
the original vectors; it stops as soon as whatever comes later would be nearer than the k-th found only with a probability below
1 - STOP. The order comes from kd-trees over projected points, a few leaves at a time, the points of these in order.

Distribution: a kd-tree fitted on at most ``FIT`` projected vectors cuts the space into at most ``CELLS`` cells, and every vector goes to its
cell; a cell is dealt in blocks of about ``BLOCK`` vectors, each with its own tree. A query first searches one block of
its home cell, which bounds its k-th distance, then only the blocks of cells that the stopping test can't rule out with that bound.
A task reads a block and then streams the queries that visit it, so it holds a block and a batch. A block is sent once, and once more for every
further ``QUERIES`` visits. A query's vector is sent once to each block it visits, in the width in which it is stored.

Equal vectors are equally far from anything and ties go to smaller ids, so of each distinct vector only the k + 1 smallest ids are
indexed; nothing is lost, and a vector that a third of all rows repeat costs k + 1 rows.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id; vectors of different
lengths are never neighbours, and each length (``LENGTHS`` at most, more raise) is a search of its own; repeated rows count once; rows with the
query's id are never its neighbours; with fewer candidates than k all are returned; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attestor import scratch

DIMS = 32
STOP = 0.9
LEAF = 64
CHUNK = 256
BLOCK = 16_384
CELLS = 4096
FIT = 20_000
QUERIES = 131_072
LENGTHS = 64
#: verified: vectors whose distance was worked out; a row without vec_id only counts them.
FOUND = "query_id long, vec_id long, score double, verified long"
RESULT = "query_id long, rank int, vec_id long, score double, verified long"


def chi2_quantile(q: float, p: int) -> float:
    """Of p degrees of freedom; the distribution function is a finite sum for even p and a series else."""

    def cdf(x: float) -> float:
        a, z = p / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return high


def projection(length: int, dims: int = DIMS, seed: int = 3) -> np.ndarray:
    """Orthogonal directions, scaled so that a projected squared distance is on average dims times the squared distance."""
    gauss = np.random.default_rng(seed).normal(size=(length, min(dims, length)))
    return np.linalg.qr(gauss)[0] * math.sqrt(length)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Splits:
    """The top of the kd-tree: medians of the widest dimension, in breadth-first order, and the cells' boxes."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.dim, self.at = depth, np.zeros(1 << depth, "i4"), np.zeros(1 << depth)
        low, high = (np.full((1 << (depth + 1), points.shape[1]), x) for x in (-np.inf, np.inf))
        held = {1: points}
        for node in range(1, 1 << depth):
            p = held.pop(node)
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            self.dim[node], self.at[node] = d, np.median(p[:, d]) if len(p) else 0.0
            right = p[:, d] > self.at[node]
            held[2 * node], held[2 * node + 1] = p[~right], p[right]
            for child in (2 * node, 2 * node + 1):
                low[child], high[child] = low[node], high[node]
            high[2 * node, d] = low[2 * node + 1, d] = self.at[node]
        self.low, self.high = low[1 << depth :], high[1 << depth :]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), "i8")
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - (1 << self.depth)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to each cell."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(1)


class Tree:
    """A kd-tree over a block's projected points, kept as its leaves and their boxes; points lie in the order of leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, matrix: np.ndarray):
        points = vectors @ matrix
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            i = todo.pop()
            if len(i) <= LEAF:
                leaves.append(i)
                continue
            d = int(np.argmax(np.ptp(points[i], axis=0)))
            half = len(i) // 2
            i = i[np.argpartition(points[i, d], half)]
            todo += [i[:half], i[half:]]
        order = np.concatenate(leaves)
        self.vectors, self.ids, self.points = vectors[order], ids[order], points[order]
        self.stop = np.cumsum([len(i) for i in leaves])
        self.start = self.stop - [len(i) for i in leaves]
        self.low = np.array([points[i].min(0) for i in leaves])
        self.high = np.array([points[i].max(0) for i in leaves])

    def search(self, query: np.ndarray, at: np.ndarray, own: int, k: int, limit: float, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest (ids, distances) not farther than ``limit``, in increasing projected distance until the test holds; and how many were verified."""
        gap = np.maximum(0, np.maximum(self.low - at, at - self.high))
        gap = (gap * gap).sum(1)
        order = np.argsort(gap, kind="stable")
        slack = 1e-9 * (1 + float(at @ at))
        best, far = np.empty(0, "i8"), np.empty(0)
        done, step, verified = 0, 1, 0
        while done < len(order):
            batch = order[done : done + step]
            batch = batch[gap[batch] <= factor * limit * limit + slack]
            if not len(batch):
                break
            done, step = done + step, min(2 * step, 32)
            i = np.concatenate([np.arange(self.start[b], self.stop[b]) for b in batch])
            d = self.points[i] - at
            d = (d * d).sum(1)
            near = np.flatnonzero((d <= factor * limit * limit + slack) & (self.ids[i] != own))
            near = near[np.argsort(d[near], kind="stable")]
            for a in range(0, len(near), CHUNK):
                some = near[a : a + CHUNK]
                some = some[d[some] <= factor * limit * limit + slack]
                if not len(some):
                    break
                x = self.vectors[i[some]] - query
                x = np.sqrt((x * x).sum(1))
                verified += len(some)
                best, far = np.append(best, self.ids[i[some]]), np.append(far, x)
                first = np.lexsort((best, far))[:k]
                best, far = best[first], far[first]
                if len(far) == k:
                    limit = min(limit, float(far[-1]))
        kept = far <= limit
        return best[kept], far[kept], verified


def _usable_rows(d: DataFrame, key: str, vector: str) -> DataFrame:
    element = d.schema[vector].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"  # floats are exact as doubles and half as wide
    v = d.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("v"))
    return v.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, stop: float = STOP) -> DataFrame:
    """RESULT: of each row of ``queries`` the k nearest rows of ``df`` other than its own; verified is the query's number of distances worked out."""
    all_rows = _usable_rows(df, key, vector)
    ranked = all_rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = scratch.cut(ranked.select("vec_id", "v"), "ann-vectors")
    asked = scratch.cut(_usable_rows(queries, key, vector), "ann-queries")
    lengths = {r.length: r["count"] for r in distinct.groupBy(F.size("v").alias("length")).count().limit(LENGTHS + 1).collect()}
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    of = lambda d, length: d.where(F.size("v") == length) if len(lengths) > 1 else d
    parts = [_search(of(distinct, length), of(asked, length), k, length, n, dims, stop) for length, n in sorted(lengths.items())]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], RESULT)


def _search(distinct: DataFrame, asked: DataFrame, k: int, length: int, n: int, dims: int, stop: float) -> DataFrame:
    matrix = projection(length, dims)
    factor = chi2_quantile(stop, matrix.shape[1])
    fit = np.array([r.v for r in distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("v").collect()], "f8") @ matrix
    depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, n / BLOCK))), int(math.log2(max(1, len(fit) // 32)))))
    splits = Splits(fit, depth)
    kind = distinct.schema["v"].dataType.simpleString()

    def to_cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cell"] = splits.cell(np.stack(pdf["v"]).astype("f8") @ matrix)
            yield pdf

    celled = scratch.cut(distinct.mapInPandas(to_cells, f"vec_id long, v {kind}, cell long"), "ann-cells")
    counts = {r.cell: math.ceil(r["count"] / BLOCK) for r in celled.groupBy("cell").count().collect()}  # at most CELLS rows
    blocks = F.create_map(*(F.lit(x).cast("int") for pair in counts.items() for x in pair))
    indexed = celled.select(F.col("cell").cast("int").alias("cell"), "vec_id", "v")
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("cell")]).cast("int"))

    def plan(first: bool):
        def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = np.stack(pdf["v"]).astype("f8") @ matrix
                home = splits.cell(at)
                out = []
                for i, q in enumerate(pdf["vec_id"]):
                    start = (int(home[i]), q % counts[int(home[i])]) if int(home[i]) in counts else None
                    if first:
                        visits = [start] if start else []
                    else:
                        reach = factor * pdf["bound"].iat[i] ** 2
                        near = np.flatnonzero(splits.gaps(at[i]) <= reach + 1e-9 * (1 + float(at[i] @ at[i])))
                        visits = [(int(c), b) for c in near for b in range(counts.get(int(c), 0)) if (int(c), b) != start]
                    out += [(q, pdf["v"].iat[i], pdf["bound"].iat[i], c, b) for c, b in visits]
                yield pd.DataFrame(out, columns=["vec_id", "v", "bound", "cell", "block"])

        return work

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, tree = None, [], None
        for pdf in batches:
            for place, group in pdf.groupby(["cell", "block", "part"], sort=False):
                if place != at:
                    at, held, tree = place, [], None
                index, ask = group[group.bound.isna()], group[group.bound.notna()]
                if len(index):
                    held.append((np.stack(index["v"]), index["vec_id"].to_numpy("i8")))
                if not len(ask) or not held:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate([h[0] for h in held]).astype("f8"), np.concatenate([h[1] for h in held]), matrix)
                    held = [()]
                out = []
                for q, v, bound in zip(ask["vec_id"], ask["v"], ask["bound"], strict=True):
                    v = np.asarray(v, "f8")
                    found, score, verified = tree.search(v, v @ matrix, q, k, bound, factor)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": [None, *found], "score": [None, *score], "verified": [verified, *[0] * len(found)]}))
                yield pd.concat(out).astype({"vec_id": "Int64", "score": "float64"})

    where = ["cell", "block", "part"]

    def run(ask: DataFrame, first: bool) -> DataFrame:
        visits = scratch.cut(ask.mapInPandas(plan(first), f"vec_id long, v {kind}, bound double, cell int, block int"), "ann-visits")
        parts = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))  # a row per block, not per vector
        parts = scratch.cut(parts, "ann-parts")
        index = indexed.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asks = visits.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        columns = [*where, "bound", "vec_id", "v"]
        rows = index.withColumn("bound", F.lit(None).cast("double")).select(*columns).unionAll(asks.select(*columns))
        # of a block, vectors come first (null), then the queries
        return rows.repartition(*where).sortWithinPartitions(*where, F.col("bound").asc_nulls_first()).mapInPandas(search, FOUND)

    home = scratch.cut(run(asked.withColumn("bound", F.lit(float("inf"))), True), "ann-home")
    bound = home.where("vec_id IS NOT NULL").groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound"))
    again = asked.join(bound, asked.vec_id == bound.query_id, "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = home.unionByName(run(again, False)).groupBy("query_id", "vec_id", "score").agg(F.sum("verified").alias("verified"))
    by = Window.partitionBy("query_id")
    rank = F.row_number().over(by.orderBy(F.col("vec_id").isNull(), "score", "vec_id"))
    found = found.withColumn("verified", F.sum("verified").over(by)).withColumn("rank", rank)
    return found.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
