import hashlib
from collections import Counter

import pytest
import regex

from attestor.llm import infill

LONG = "word number of a long text\n" * 40_000


def brute(key, text, unit=r"(?s:.)", salt="1"):
    text = text or ""
    digest = hashlib.sha256(f"{salt}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    found = list(regex.finditer(unit, text))
    n = len(found)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    i, j = (found[k - 1].end() if k else 0 for k in (a, b))
    p, m, s = text[:i], text[i:j], text[j:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def check(rows, unit=r"(?s:.)"):
    for r in rows:
        want = brute(r.doc_id, r.text, unit)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.output_sha256 == hashlib.sha256(want[-1].encode()).hexdigest() and r.back == (r.text or "")


TEXTS = [None, "", "a", "\n", "ab", "<P> holds one", "x<S>", "<M", "<<S", "<S", ">", "<P", "M><S", "é😀é\r\n", "𝔘𝔫" * 50, "don't  stop\n\nnow", LONG, "\0nul"]


@pytest.mark.parametrize("unit", [infill.CODE_POINT, r"\S+\s*", r"[^\n]*\n", r"\X"])
def test_equals_plain_python_and_comes_back(spark, unit):
    rows = [(i if i % 11 else None, t, "x", 7) for i, t in enumerate([*TEXTS * 8, LONG])]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, __infill long").repartition(3)
    got = infill.transform(df, unit=unit)
    assert got.columns == ["doc_id", "text", "__infill", *infill.OWN]
    rows = got.withColumn("back", infill.restored("form", "output")).collect()
    assert len(rows) == 8 * len(TEXTS) + 1
    check(rows, unit)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_shares_ties_repeats_and_empty(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some text of one kind' AS text")
    rows = infill.transform(df.unionAll(df)).collect()
    forms = Counter(r.form for r in rows)
    assert 0.08 < forms["plain"] / 8000 < 0.12 and 0.15 < forms["spm"] / 8000 < 0.21
    assert all(n == 2 for n in Counter((r.doc_id, r.output) for r in rows).values())
    assert infill.transform(df.limit(0)).count() == 0
    assert {r.form for r in infill.transform(df, transformed=0).collect()} == {"plain"}
    assert {r.form for r in infill.transform(df, transformed=100, suffix_first=100).collect()} == {"spm"}


def test_a_unit_cannot_be_empty(spark):
    with pytest.raises(ValueError):
        infill.transform(spark.createDataFrame([], "doc_id long, text string"), unit="x*")
