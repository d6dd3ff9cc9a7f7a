"""Tokens of the index, cut by tables, against those of the regular expression; and passages that hold wanted terms, with and without postings."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import lexical as L

CHARACTERS = [chr(c) for c in range(0x260)]
TEXTS = [f"a{c}B {c}{c} x_1" for c in CHARACTERS] + ["".join(CHARACTERS), "", None, "ende", "ß", "Straße", " ", "é" * 5, "Ωσς ßx\U00010400", "日本 text", "Das ist GROSS", "text"]


@pytest.mark.parametrize("characters", [L.CHARACTERS, 3])
def test_tables_cut_as_the_expression_does(spark, characters, monkeypatch):
    """All texts went through the expression, and terms through rows as lists."""
    monkeypatch.setattr(L, "CHARACTERS", characters)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "ref long, text string").coalesce(2)
    index = L.build(docs)
    assert index.passages.columns == ["ref", "dl", "words", "times"]
    want = {r.ref: Counter(r.t) for r in docs.select("ref", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    got = {r.ref: (r.dl, Counter()) for r in index.passages.collect()}
    for r in L.posted(index.passages).collect():
        got[r.ref][1][r.term] = r.tf
    assert got == {ref: (sum(t.values()), t) for ref, t in want.items()}
    df = Counter(t for own in want.values() for t in own)
    assert {r.term: r.df for r in index.terms.collect()} == df and index.total == sum(df.values())


def test_few_wanted_terms_make_no_postings(spark, monkeypatch):
    """The postings of all terms were written, sorted, for the terms of a few items."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three four", "two three", "bone", "one", "", None, "-- one -- two three", "three two two"])], "ref long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "one"), (3, "--"), (4, "e two three f"), (5, ""), (6, None)], "query_id long, text string")

    def told():
        index = L.build(docs)
        held = sorted(map(tuple, L.holding(index, docs, items).collect()))
        return index, held, sorted(map(tuple, L.held(index, L.rarest(index, items)).collect()))

    index, *few = told()
    assert not index._made and few[0] == [(1, 0), (1, 1), (1, 6), (2, 0), (2, 2), (2, 3), (2, 6), (3, 6), (4, 0)]
    monkeypatch.setattr(L, "WANTED", 0)
    index, *many = told()
    assert index._made and many == few
