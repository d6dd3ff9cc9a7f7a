"""Very long texts, ties, repeats, nulls and clashing names for operators whose own tests hold few of them."""

import hashlib
from collections import Counter

import pytest

from attestor import scratch
from attestor.llm import filters, mixing, packing, quality, tokens, warc

LONG = "word number of a long text\n" * 40_000


def test_warc_with_very_long_payloads_repeats_and_clashes(spark):
    pages = [(1, "u", LONG), (2, None, LONG), (2, None, LONG), (3, "u\r\nx", None), (None, "u", LONG + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"), (4, "u", "short"), (5, "u", "short")]
    df = spark.createDataFrame([(*p, 1, "d", "h") for p in pages], "page_id long, url string, html string, first int, digest string, revisit string")
    path = scratch.new_path(spark, "warc")
    warc.write(df, path)
    rows = warc.read(spark, path).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == Counter((p, len((t or "").encode()), digest(t)) for p, _, t in pages)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (None, "response", None), (4, "response", None), (5, "response", None)])


def test_packing_of_very_long_texts_ties_and_null_ids(spark):
    df = spark.createDataFrame([(1, LONG, 2), (1, LONG, 2), (None, "x", 3), (None, None, 4)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(packing.pieces(df, tokenizer=tokens.byte_bpe())).collect()
    n = len(tokens.encoder(tokens.byte_bpe())(LONG)) // 4 + 1
    per = Counter()
    for r in rows:
        per[r.doc_id, r.doc_tokens] += r.length
    assert per == {(1, n): 2 * n, (None, 2): 2, (None, 1): 1}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 2 * n // 2048 + 3


def test_quality_of_very_long_texts_ties_and_clashes(spark):
    texts = [LONG, "# " * 200_000, "a\n" * 100_000, None, "one two three four five six seven eight nine ten eleven"] * 30
    df = spark.createDataFrame([(i // 2, t, None if i % 3 else "en", "s", "x", 1, True) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string, x0 string, stratum int, kept boolean")
    got = quality.judge(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "x0", "stratum", *quality.STATS, "base_failed", "distance", "kept"]
    rows = got.collect()
    assert len(rows) == len(texts) and all(r.kept for r in rows if r.text and r.text.startswith("one"))
    assert {r.n_words for r in rows if r.text == LONG} == {240_000} and all(r.base_failed for r in rows if r.text is None or r.text == LONG)
    assert quality.judge(df.limit(0)).count() == 0


def test_mixing_counts_of_very_long_texts_and_tied_rows(spark):
    rows = [(1, "a", LONG), (1, "a", LONG), (1, "a", "other words"), (None, None, "z " * 50)] * 2
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, pieces int, first_shard int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and Counter(r["size"] for r in got) == Counter(len((t or "").split()) for _, _, t in rows)
    assert all(r.taken <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("keys", [[], [3, 3, None], list(range(500))])
def test_filters_never_miss_a_key(spark, keys):
    rows = spark.createDataFrame([(i, "x") for i in [*range(1000), None]], "k int, bucket string")
    held = spark.createDataFrame([(k,) for k in keys], "k int")
    hit = {r.k for r in filters.marked(rows, held, "k").where("__hit").collect()}
    assert set(keys) <= hit and len(hit) <= len(set(keys)) + 2
