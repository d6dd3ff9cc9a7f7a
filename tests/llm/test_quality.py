import re
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from attestor.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check(rows):
    for r in rows:
        got = tuple(r[c] for c in quality.STATS)
        assert got == brute(r.text), r.text
        n, _, _, _, repeat = got
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c d", "a b c d e", "a b c d e a b c d e", "a " * 400, "x\ny\nx\n\nx\n", "#*$%&|<> ünï   😀", "l\r\nl\r\n", "one two three four five six " * 300, "w" * 300_000]
    df = spark.createDataFrame([(i, t, None, "s", 7) for i, t in enumerate(texts + texts)], "doc_id long, text string, lang string, source string, n_words int")
    rows = quality.judge(df).collect()
    assert len(rows) == 2 * len(texts)
    check(rows)
    empty = quality.judge(df.limit(0))
    assert empty.count() == 0 and empty.columns.count("n_words") == 1


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "#", "é", "\x0b", "ab"]), max_size=60).map("".join), min_size=1, max_size=80))
def test_statistics_against_brute_force(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text").transform(lambda d: quality.statistics(d)).collect()
    assert [tuple(r[c] for c in quality.STATS) for r in rows] == [brute(r.text) for r in rows]


def by_hand(x):
    """The same concentration steps in numpy."""
    def fit(rows, factor):
        return rows.mean(0), np.cov(rows.T, bias=True) * factor + np.diag(np.square(quality.FLOOR))

    def distance(m, c):
        d = x - m
        return np.einsum("ij,ij->i", d @ np.linalg.inv(c), d)

    m = np.median(x, 0)
    starts = [(m, np.diag((1.4826 * np.median(abs(x - m), 0)) ** 2 + np.square(quality.FLOOR))), fit(x, 1)]
    best = []
    for m, c in starts:
        for _ in range(quality.STEPS):
            d = distance(m, c)
            m, c = fit(x[d <= np.sort(d)[int(np.ceil(quality.H * len(x))) - 1]], quality.CONSISTENT)
        best.append((np.linalg.slogdet(c)[1], distance(m, c)))
    return min(best, key=lambda b: b[0])[1]


def test_estimate_resists_a_third_of_junk(spark):
    rng = np.random.default_rng(5)
    clean = rng.normal(0, 1, (900, quality.P)) @ np.tril(rng.normal(0, 1, (quality.P, quality.P)))
    junk = rng.normal(0, 0.3, (200, quality.P)) + 25
    x = np.vstack([clean, junk])
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "stratum long, " + ", ".join(f"x{i} double" for i in range(quality.P)))
    est = quality.estimates(df)
    got = np.array([r.d2 for r in df.join(est, "stratum").select("x0", quality._squared([F.col(f"x{i}") for i in range(quality.P)]).alias("d2")).collect()])
    assert np.allclose(np.sort(got), np.sort(by_hand(x)), rtol=0.05)
    assert (got > 60).sum() == 200


def test_chi_square():
    assert abs(quality.chi2_cdf(3.84145882, 1) - 0.95) < 1e-6 and abs(quality.chi2_quantile(0.99, 5) - 15.08627) < 1e-4


def test_labelled_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    assert all(tuple(r[c] for c in quality.STATS) == brute(texts[r.doc_id]) for r in rows)


def test_outliers_of_small_strata_are_judged_by_all_documents(spark):
    rng = np.random.default_rng(4)
    clean = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(rng.integers(60, 200))) for _ in range(60)]
    soup = " ".join(f"#$%{i}&|<>*" for i in range(80))
    rows = [(i, t, "en", "web") for i, t in enumerate(clean)] + [(100, soup, "en", "web"), (101, soup + " end", "xx", None)]
    for more in ([], [(200 + i, t + " more", "de", "web") for i, t in enumerate(clean * 4)]):
        df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
        assert {r.doc_id for r in quality.judge(df).collect() if not r.kept} == {100, 101}
