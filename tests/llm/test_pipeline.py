import re
from collections import Counter

import corpus_pipeline
from attestor import scratch
from attestor.llm import mixing, neardup, quality, tokens
from attestor.llm.tables import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [scratch.cut(docs, "t")]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.cut(stage(spark, kept[-1], SF), "t"))
    raw, good, single, clean, mixed, packed = kept
    for df in kept[:-1]:
        assert df.columns == list(DOCUMENT_COLUMNS)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(raw).where("kept").collect()}
    assert Counter(r.doc_id for r in single.collect()) == Counter(r.doc_id for r in neardup.classes(good).where("kept").collect())
    before, after = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r for r in clean.collect()}
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    assert any(before[k] != after[k].text for k in before)
    # words of each document in the mix: as many as its operator says, every one from the document and in order within a turn
    taken, words = Counter(), {k: WORD.findall(r.text) for k, r in after.items()}
    for r in mixed.collect():
        own = iter(words[r.doc_id])
        got = WORD.findall(r.text)
        assert got and all(w in own for w in got)
        taken[r.doc_id] += len(got)
    sizes = Counter()
    for k, r in after.items():
        sizes[r.source] += len(words[k])
        assert taken[k] <= 3 * len(words[k])
    goal = {r.source: r.target for r in mixing.mix(clean).select("source", "target").distinct().collect()}
    for s in goal:
        assert abs(sum(n for k, n in taken.items() if after[k].source == s) - goal[s]) <= max(mixing.BLOCK_WORDS, 0.02 * goal[s])
    encode = tokens.encoder(tokens.byte_bpe())
    assert sum(r.length for r in packed.collect()) == sum(len(encode(r.text)) // 4 + 1 for r in mixed.collect())


def test_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a few words of text that are long enough to be kept here now", None, None, 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.cut(stage(spark, docs, SF), "t")
        assert bool(docs.count()) == bool(rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
