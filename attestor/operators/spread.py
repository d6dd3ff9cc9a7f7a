"""Medians of each query's cosines with all vectors, exactly, without a pair that leaves its task.

Cosines are rounded to nine digits, so they are whole numbers of nano units. A sample of the vectors tells between which numbers a median will be; a sweep counts what lies below
and counts, by steps, what lies between. Steps of one give the median at once; they are taken where little lies between, else the step that holds the median is
what the next sweep looks at. A median that isn't where the sample had it is looked for where the counts say, so the sample only saves sweeps. One or two sweeps find the
middle of the scores and as many the middle of the distances from it. What a task holds and hands over has a bound for each query, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestor import scratch
from attestor.operators import retrieval as R

UNIT = 10**R.DIGITS
#: No score, and no distance in half units, is beyond.
END = 5 * UNIT
#: Steps between two numbers, and what may lie between them, all tasks together, if each number is told by itself.
STEPS, TOLD = 256, 4096
#: More than any number of steps.
STEPS_MOST = 1 << 34
#: Vectors of the sample.
SAMPLE = 16_384
#: Vectors that are dealt together to a block of queries, if there are several blocks.
DEAL = 1 << 15
#: Numbers that are held before they are counted together.
HELD = 1 << 20
#: Scores that are counted at once: few enough for a core's own memory.
CELLS = 1 << 18
#: Queries whose counts are put together at once.
NARROWED = 64


class Counted(R.Cosines):
    """Counts of each query's scores below ``low``, and by steps of ``step`` from there to ``high``; the least one beyond, and the best. With ``middle`` (in half units) it is the scores' distances from it that count."""

    def __init__(self, asks: pd.DataFrame):
        super().__init__(asks, None)
        own = {width: rows for width, rows in asks.groupby(asks["v"].map(len))}
        self.sought = {width: [rows[c].to_numpy("i8") for c in ("low", "high", "step")] for width, rows in own.items()}
        self.middle = {width: None if rows["middle"].isna().all() else rows["middle"].to_numpy("f8") for width, rows in own.items()}
        self.told = {width: {"n": 0, "below": np.zeros(len(rows), "i8"), "over": np.full(len(rows), np.inf), "best": np.full(len(rows), -np.inf)} for width, rows in own.items()}
        #: Numbers of queries whose steps are counted in a table, and the table; numbers told by themselves are held as codes.
        self.coarse = {width: np.flatnonzero(step > 1) for width, (_, _, step) in self.sought.items()}
        self.table = {width: np.zeros((len(rows), STEPS), "i4") for width, rows in self.coarse.items()}
        self.steps: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {width: [] for width in own}

    def batch(self, rows: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        for width, _, got in self.matrices(rows, max(1, CELLS // max([1, *map(len, self.groups.values())]))):
            self.tally(width, got)
        yield from ()

    def tally(self, width: int, got: np.ndarray) -> None:
        told, (low, high, step), middle = self.told[width], self.sought[width], self.middle[width]
        np.rint(np.multiply(got, UNIT, out=got), out=got)
        told["n"] += len(got)
        told["best"] = np.maximum(told["best"], got.max(axis=0))
        if middle is not None:
            np.abs(np.subtract(np.multiply(got, 2, out=got), middle, out=got), out=got)
        before, beyond = got < low, got > high
        told["below"] += np.count_nonzero(before, axis=0)
        at = np.flatnonzero(~(before | beyond))
        j = at % len(low)
        code = (got.reshape(-1)[at].astype("i8") - low[j]) // step[j]
        by_step = step[j] > 1
        place = np.zeros(len(low), "i8")
        place[self.coarse[width]] = np.arange(len(self.coarse[width])) * STEPS
        np.add.at(self.table[width].reshape(-1), place[j[by_step]] + code[by_step], 1)
        j, code = j[~by_step], code[~by_step]
        self.steps[width].append((j * STEPS_MOST + code, np.ones(len(j), "i8")))
        if sum(len(codes) for codes, _ in self.steps[width]) > 2 * HELD:
            self.steps[width] = [self.gathered(width)]
        exact = np.flatnonzero(step == 1)  # what follows a number matters where numbers are told
        if len(exact):
            got[~beyond] = np.inf
            told["over"][exact] = np.minimum(told["over"], got.min(axis=0))[exact]

    def gathered(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        codes, many = (np.concatenate(c) for c in zip(*self.steps[width], strict=True))
        found, at = np.unique(codes, return_inverse=True)
        return found, np.bincount(at, many, len(found)).astype("i8")

    def end(self) -> Iterator[pd.DataFrame]:
        for width, ids in self.groups.items():
            told = self.told[width]
            if not told["n"]:
                continue
            codes, many = self.gathered(width)
            row, at = np.nonzero(table := self.table[width])
            codes, many = np.concatenate([codes, self.coarse[width][row] * STEPS_MOST + at]), np.concatenate([many, table[row, at]])
            order = np.argsort(codes)
            codes, many = codes[order], many[order].astype("i8")
            cuts = np.searchsorted(codes, np.arange(1, len(ids)) * STEPS_MOST)
            lists = lambda a: np.split(a, cuts)
            out = pd.DataFrame({"query_id": ids, "n": told["n"], "best": told["best"], "below": told["below"], "over": np.where(np.isinf(told["over"]), END, told["over"]).astype("i8")})
            out["low"], out["high"], out["step"] = self.sought[width]
            out["steps"], out["many"] = lists(codes % STEPS_MOST), lists(many)
            for at in range(0, len(out), 256):
                yield out.iloc[at : at + 256]


def _narrowed(pdf: pd.DataFrame) -> pd.DataFrame:
    """What all tasks have told of some queries, and their low, high and step before, as their next ones; ``found`` where low and high are the two middle numbers."""
    code, ids = pd.factorize(pdf["query_id"])
    told = {c: pdf[c].to_numpy() for c in ("n", "best", "below", "over", "low", "high", "step", "steps", "many")}
    of = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])
    return pd.DataFrame([{"query_id": q} | _next({c: column[rows] for c, column in told.items()}) for q, rows in zip(ids, of, strict=True)])


def _next(told: dict[str, np.ndarray]) -> dict:
    n, below, over, first, step, high = int(told["n"].sum()), int(told["below"].sum()), int(told["over"].min()), int(told["low"][0]), int(told["step"][0]), int(told["high"][0])
    steps, at = np.unique(np.concatenate(told["steps"]).astype("i8"), return_inverse=True)
    ends = below + np.cumsum(np.bincount(at, np.concatenate(told["many"]), len(steps)).astype("i8"))
    # of n scores the best is left out; it is the last by score, and by distance no earlier than half of the rest
    ranks = max((n - 2) // 2, 0), max((n - 1) // 2, 0)
    last = int(ends[-1]) if len(ends) else below
    out = {"n": n, "best": float(told["best"].max()), "found": False, "step": 1}
    if ranks[0] < below:
        low, high, inside = -END, first - 1, below
    elif ranks[0] >= last:
        low, high, inside = high + 1, END, n - last
    else:
        i = int(np.searchsorted(ends, ranks[0], "right"))
        if step == 1:
            k = int(np.searchsorted(ends, ranks[1], "right"))
            return out | {"found": True, "low": first + int(steps[i]), "high": first + int(steps[k]) if k < len(ends) else over}
        low, inside = first + int(steps[i]) * step, int(ends[i] - (ends[i - 1] if i else below))
        high = min(low + step - 1, high)
    return out | {"low": low, "high": high, "step": 1 if inside <= TOLD else -(-(high - low + 1) // STEPS)}


def _sampled(rows: pd.DataFrame, many: int):
    """A function that gives queries (query_id, v and, for distances, middle) the numbers between which a sample of ``many`` vectors has their median."""
    units = {width: R.units(np.stack(own)) for width, own in rows["v"].groupby(rows["v"].map(len))}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[at : at + R.CELLS // SAMPLE + 1] for batch in batches for at in range(0, len(batch), R.CELLS // SAMPLE + 1)):
            for width, own in pdf.groupby(pdf["v"].map(len)):
                low, high, inside = np.full(len(own), -END), np.full(len(own), END), float(many)
                if width in units and len(units[width]) >= 64:
                    m, got = len(units[width]), np.rint(R.units(np.stack(own["v"])) @ units[width].T * UNIT)
                    if not own["middle"].isna().all():
                        got = np.abs(2 * got - own["middle"].to_numpy("f8")[:, None])
                    reach = int(2 * m**0.5) + 1  # four deviations of a rank
                    at = max((m - 1) // 2 - reach, 0), min(m // 2 + reach, m - 1)
                    got.partition(at, axis=1)
                    low, high, inside = got[:, at[0]].astype("i8"), got[:, at[1]].astype("i8"), 2 * reach * many / m
                step = np.ones(len(own), "i8") if inside <= TOLD else np.maximum(-(-(high - low + 1) // STEPS), 1)
                yield own.assign(low=low, high=high, step=step)

    return work


def middles(passages: DataFrame, queries: DataFrame, block: int = R.QUERY_BLOCK) -> DataFrame:
    """(query_id, n, best, mid, mad) of the cosines of each query vector with every passage vector: their number, the best, the median of the others, and the median of the others' distances from that.

    The scores are those of ``retrieval.cosine``; queries that nothing can be compared with are left out, mid and mad are null where there is no other score.
    """
    rows = R.vectors(passages, "ref")
    sample = rows.orderBy(F.xxhash64("ref"), "ref").limit(SAMPLE).select("v").toPandas()
    vectors = scratch.cut(R.vectors(queries, "query_id"), "query-vectors")
    many, all_ = vectors.count(), rows.count()
    key = vectors.schema["query_id"].dataType.simpleString()
    schema = f"query_id {key}, n long, best double, below long, over long, low long, high long, step long, steps array<long>, many array<long>"
    middle, done = F.lit(None).cast("long"), None
    for _ in ("scores", "distances"):
        asks = vectors.withColumn("middle", middle) if done is None else vectors.join(done.select("query_id", middle.alias("middle")), "query_id")
        asks = scratch.cut(asks.mapInPandas(_sampled(sample, all_), f"query_id {key}, v array<double>, middle long, low long, high long, step long"), "asked-middles")
        parts = []
        while True:
            counts = R.sweep(rows, asks, Counted, block=block, schema=schema, deal=DEAL, many=many if not parts else None)
            some = counts.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, many // NARROWED))).alias("some"))
            found = scratch.cut(some.applyInPandas(_narrowed, f"query_id {key}, n long, best double, found boolean, step long, low long, high long"), "narrowed")
            parts.append(found.where("found"))
            if found.where("NOT found").isEmpty():
                break
            asks = scratch.cut(asks.select("query_id", "v", "middle").join(found.where("NOT found").select("query_id", "low", "high", "step"), "query_id"), "asked-middles")
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        if done is None:
            done, middle = found.select("query_id", "n", "best", "low", "high"), F.col("low") + F.col("high")
    several = lambda c: F.when(F.col("n") > 1, c)
    spread = found.select("query_id", (F.col("low") + F.col("high")).alias("around"))
    return done.join(spread, "query_id").select(
        "query_id", "n", (F.col("best") / UNIT).alias("best"), several((F.col("low") + F.col("high")) / (2 * UNIT)).alias("mid"), several(F.col("around") / (4 * UNIT)).alias("mad"),
    )
