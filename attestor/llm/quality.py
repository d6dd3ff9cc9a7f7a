"""Quality rules: fixed base rules and robust multivariate outliers, in DataFrame functions only.

Statistics are computed for whole texts. Documents that pass the base rules become vectors of transformed statistics. For
each stratum (language and source; where those have too few documents the language, else all that are left, which
are judged by an estimate from all documents if they are fewer than ``LEAST``) the
minimum-covariance-determinant estimate is found by concentration steps: take the share ``H`` of documents with the smallest
Mahalanobis distance, estimate mean and covariance from them, repeat. Two deterministic starts (medians with absolute deviations,
and the plain mean and covariance) run side by side; the smaller determinant wins. A document is rejected if its distance
under that estimate exceeds the cutoff.

All documents take part in every step; a step is a join with one row of parameters per stratum and an aggregation of sums that is
combined before the shuffle, so a hot source costs no more than its rows. Vectors are written once and reread.

Cutoff: the chi-square quantile at ``1 - TAIL``. Statistics of clean text have heavier tails than the normal law, so the tail is far out; the
least standard deviations in ``FLOOR`` keep a statistic that hardly varies from rejecting small deviations.

Defined cases: null text has no words and fails the base rules; a null language or source is a value of its own; repeated rows
count and are kept row by row; of fewer than ``FEWEST`` documents in all, too few for a covariance of ``P`` statistics, none is an outlier; an empty table gives an empty
result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from attestor import scratch
from attestor.llm.tables import WORD

SYMBOLS = "[#*$%&|<>]"
LEAST = 200
FEWEST = 20
H = 0.75
#: Concentration stops when no determinant's logarithm changes by more than SETTLED, and after STEPS at the latest.
STEPS, SETTLED = 20, 1e-3
TAIL = 1e-9
#: Per transformed statistic, the standard deviation that is added to the estimate's.
FLOOR = (0.25, 0.15, 0.5, 1.0, 1.0)
P = len(FLOOR)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OWN = (*STATS, "base_failed", "distance", "kept")


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more: equal windows meet by sorting their hashes, and what they cover is added up."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.struct(F.xxhash64(*(F.element_at(words, (i + k).cast("int")) for k in range(5))).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 5, windows)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with STATS of the whole text and without clashing columns; the text stays."""
    kept = [c for c in df.columns if c.lower() not in OWN]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(*(F.col(f"`{c}`") for c in kept), whole.alias("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("__w", F.sort_array(_repeat_words(F.col("__words"))))
    n = F.size("__w")

    def again(x: Column, i: Column) -> Column:
        after = F.when(i + 1 < n, F.element_at(F.col("__w"), (i + 2).cast("int"))["h"])
        before = F.when(i > 0, F.element_at(F.col("__w"), F.greatest(i, F.lit(1)).cast("int"))["h"])
        return F.coalesce(x["h"] == after, F.lit(False)) | F.coalesce(x["h"] == before, F.lit(False))

    rows = rows.withColumn("__at", F.sort_array(F.transform(F.filter("__w", again), lambda x: x["i"])))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i.cast("int") - s["last"])).alias("n"), i.cast("int").alias("last")))["n"]
    return rows.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size("__words").cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: logarithms of sizes and ratios, so that their bulk is roughly elliptical."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log((F.col("word_chars") + 1) / n) * 2,
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def chi2_cdf(x: float, p: float) -> float:
    """Of p degrees of freedom: the lower incomplete gamma function by its series."""
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


def chi2_quantile(q: float, p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


#: Makes the scatter of the central share H consistent with the whole's covariance under a normal law.
CONSISTENT = H / chi2_cdf(chi2_quantile(H, P), P + 2)


def strata(rows: DataFrame) -> DataFrame:
    """The languages and sources of ``rows`` with their numbers n and the stratum each is judged in: 0 by language and source, 1 by language, 2 all that are left."""
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("fine", F.col("n") >= LEAST)
    langs = pairs.where(~F.col("fine")).groupBy("lang").agg((F.sum("n") >= LEAST).alias("coarse"))
    p, q = pairs.alias("p"), langs.alias("q")
    named = p.join(q, F.col("p.lang").eqNullSafe(F.col("q.lang")), "left").select(
        F.col("p.lang").alias("lang"), F.col("p.source").alias("source"), F.col("p.n").alias("n"),
        F.when(F.col("fine"), F.xxhash64(F.lit(0), "p.lang", F.coalesce("p.source", F.lit("")), F.col("p.source").isNull()))
        .when(F.col("coarse"), F.xxhash64(F.lit(1), "p.lang")).otherwise(F.lit(2)).alias("stratum"),
    )
    return named


def _parameters() -> list[str]:
    return [*(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i in range(P) for j in range(i + 1))]


def _whitened(est: DataFrame, keys: list[str]) -> DataFrame:
    """From Cholesky factors l, their inverses w, row by row; the squares of w (x - m) add up to the squared Mahalanobis distance."""
    for i in range(P):
        est = est.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i):
            total = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"w{i}{j}", -total / F.col(f"l{i}{i}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return est.select(*keys, F.col("n").cast("double").alias("n"), det.alias("logdet"), *_parameters())


def _estimate(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and covariance with the floor added, per key, the latter as the inverse of its Cholesky factor."""
    x = [F.col(f"x{i}") for i in range(P)]
    sums = [F.count("*").alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(P)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    est = scratch.cut(rows.groupBy(*keys).agg(*sums), "mcd-moments")  # few rows; cut, as what follows nests deeply
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") * factor + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return _whitened(est, keys)


def _squared(x: list[Column]) -> Column:
    rows = (sum((F.col(f"w{i}{j}") * (x[j] - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P))
    return sum((r * r for r in rows), F.lit(0.0))


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The MCD estimate of every stratum from ``rows`` (stratum, x0, x1, ...)."""
    x = [f"x{i}" for i in range(P)]
    # tables of a row per stratum are written before they are joined, so that Spark knows their size and sends them to the rows
    middle = scratch.cut(rows.groupBy("stratum").agg(*(F.percentile_approx(c, F.lit(0.5), F.lit(10_000)).alias(f"m{i}") for i, c in enumerate(x))), "mcd-middle")
    spread = rows.join(middle, "stratum").groupBy("stratum").agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), F.lit(0.5), F.lit(10_000)).alias(f"s{i}") for i, c in enumerate(x)), *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)))
    zero = F.lit(0.0)
    diagonal = spread.select("stratum", F.lit(0).alias("n"), *(f"m{i}" for i in range(P)), *((F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + FLOOR[i] ** 2) if i == j else zero).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)))
    keys = ["stratum", "start"]
    robust = _whitened(scratch.cut(diagonal, "mcd-medians"), ["stratum"]).withColumn("start", F.lit(0))
    plain = _estimate(rows, ["stratum"], 1.0).withColumn("start", F.lit(1))
    est = scratch.cut(robust.unionByName(plain), "mcd-start")
    for step in range(steps):
        near = rows.join(est, "stratum").select(*keys, *x, _squared([F.col(c) for c in x]).alias("d2"))
        limit = scratch.cut(near.groupBy(*keys).agg(F.percentile_approx("d2", F.lit(H), F.lit(10_000)).alias("h")), "mcd-limit")
        inside = near.join(limit, keys).where(F.col("d2") <= F.col("h"))
        est, old = scratch.cut(_estimate(inside, keys, CONSISTENT), f"mcd-{step}"), est
        change = est.join(old.select(*keys, F.col("logdet").alias("was")), keys).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        scratch.drop(old, limit)
        if change is None or change < SETTLED:
            break
    best = est.groupBy("stratum").agg(F.min(F.struct("logdet", "start")).alias("b")).select("stratum", F.col("b.start").alias("start"))
    return est.join(best, keys).drop("start")


def judge(df: DataFrame, *, text: str = "text", keep_text: bool = True, tail: float = TAIL) -> DataFrame:
    """``df`` (lang, source and the text) with OWN."""
    stats = statistics(df, text).withColumn("base_failed", base_failed())
    # written before anything filters by it: a predicate moved below these projections would work out the windows for each of their words
    return verdicts(scratch.cut(stats if keep_text else stats.drop(text), "quality-statistics"), tail=tail)


def verdicts(stats: DataFrame, *, tail: float = TAIL) -> DataFrame:
    """Rows with STATS and base_failed, with distance (null where the base failed or there are fewer than FEWEST documents) and kept."""
    keys = [F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    passed = stats.where(~F.col("base_failed")).select(*keys, *(c.alias(f"x{i}") for i, c in enumerate(vector())))
    vectors = scratch.cut(passed, "mcd-vectors")
    named = scratch.cut(strata(vectors), "mcd-strata")
    v, s = vectors.alias("v"), named.alias("s")
    same = F.col("v.lang").eqNullSafe(F.col("s.lang")) & F.col("v.source").eqNullSafe(F.col("s.source"))
    rows = scratch.cut(v.join(s, same).select("s.stratum", *(f"v.x{i}" for i in range(P))), "mcd-rows")
    left, total = named.agg(F.sum(F.when(F.col("stratum") == 2, F.col("n"))), F.sum("n")).first()
    judging = rows
    if left and left < LEAST:  # too few for an estimate of their own
        judging = rows.where("stratum <> 2").unionByName(rows.withColumn("stratum", F.lit(2).cast("long")))
    est = estimates(judging).where(F.lit((total or 0) >= FEWEST))
    fitted = scratch.cut(named.drop("n").join(est, "stratum"), "mcd-fitted").drop("stratum")
    scratch.drop(rows, vectors)
    limit = chi2_quantile(1 - tail, P)
    a, b = stats.alias("a"), fitted.alias("b")
    same = F.col("a.lang").cast("string").eqNullSafe(F.col("b.lang")) & F.col("a.source").cast("string").eqNullSafe(F.col("b.source"))
    out = a.join(b, same, "left").select(*(F.col(f"a.`{c}`") for c in stats.columns), *(F.col(f"b.{c}") for c in _parameters()))
    distance = F.when(~F.col("base_failed"), _squared(vector()))
    return out.select(*(F.col(f"`{c}`") for c in stats.columns), distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit))
