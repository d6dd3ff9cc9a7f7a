"""The pipeline's stages against plain Python that shares no code with the operators, stage by stage on the input that the stage really has."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from attestor import scratch
from attestor.llm import quality, tokens
from attestor.llm.tables import DOCUMENT_COLUMNS
from tests.llm import test_neardup, test_pii, test_quality
from tests.llm.test_mixing import waterfill

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    """Documents with nulls, repeats, a very long text and copies, and what each stage makes of them; columns that stages use for themselves clash."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENT_COLUMNS)
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    extra = [(10_001, None, None, None, None), (None, "", "en", "a", 0), (10_002, long, "en", "src0", len(long)), (10_003, long + " tail", None, None, 3), (10_002, long, "en", "src0", len(long)), (10_004, "few", "en", "b", 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for name in ("turn", "slot", "kept", "spans", "key", "__hit", "size"):
        docs = docs.selectExpr("*", f"'{name}' AS `{name}`")
    out = [scratch.cut(docs, "t")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.cut(stage(spark, out[-1], SF), "t"))
    return [t.collect() for t in out]


def rows(table):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in table)


def test_quality_rules(tables):
    raw, good = tables[:2]
    passed, vectors = [], []
    for r in raw:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = test_quality.brute(r.text)
        if n_words >= 10 and 100 * n_repeat <= 20 * n_words:
            passed.append(r)
            vectors.append([np.log(n_words), 2 * np.log((word_chars + 1) / n_words), np.log1p(100 * n_symbols / n_words), np.log1p(n_dup_lines), np.log1p(100 * n_repeat / n_words)])
    assert len(passed) < quality.LEAST  # so all are judged by one estimate
    distance = test_quality.by_hand(np.array(vectors))
    limit = quality.chi2_quantile(1 - quality.TAIL, quality.P)
    sure = Counter((r.doc_id, r.text, r.lang, r.source) for r, d in zip(passed, distance, strict=True) if d < 0.97 * limit)
    open_ = Counter((r.doc_id, r.text, r.lang, r.source) for r, d in zip(passed, distance, strict=True) if 0.97 * limit <= d < 1.03 * limit)
    got = rows(good)
    assert not sure - got and not got - sure - open_ and len(got) < len(raw)


def test_near_duplicates(tables):
    good, single = tables[1:3]
    docs = [(r.doc_id, r.text) for r in good if r.doc_id is not None]
    classes = test_neardup.brute(docs, test_neardup.exact_weights(t for _, t in docs))
    assert sorted(r.doc_id for r in single) == sorted(set(classes.values()))
    assert not rows(single) - rows(good)


def redacted(text):
    spans, out, at = test_pii.brute(text), [], 0
    for start, kind, stop in spans:
        if start >= at:
            out += [text[at:start], ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[kind]]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def test_personal_data(tables):
    single, clean = tables[2:4]
    want = {r.doc_id: redacted(r.text) for r in single}
    got = {r.doc_id: r for r in clean}
    assert want.keys() == got.keys() and any(want[k] != r.text for k, r in zip((r.doc_id for r in single), single))
    differ = [k for k in want if got[k].text != want[k]]
    # beyond the base spans only digits or spelled-out addresses may have gone
    assert len(differ) <= 0.02 * len(want) and all(re.search(r"[0-9]{4}|\[at\]", want[k]) for k in differ)
    assert all(r.n_chars == len(r.text) for r in clean)


def test_mixing(tables):
    clean, mixed = tables[3:5]
    words = {r.doc_id: WORD.findall(r.text) for r in clean}
    sizes, taken, per = Counter(), Counter(), Counter()
    for r in clean:
        sizes[r.source] += len(words[r.doc_id])
    for r in mixed:
        own = iter(words[r.doc_id])
        got = WORD.findall(r.text)
        assert got and all(w in own for w in got) and r.n_chars == len(r.text)
        taken[r.source] += len(got)
        per[r.doc_id] += len(got)
    for s, goal in waterfill(sizes).items():
        assert abs(taken[s] - goal) <= max(64, 0.02 * goal), s
    assert all(n <= 3 * len(words[k]) for k, n in per.items())


def test_packing(tables):
    mixed, packed = tables[4:6]
    encode = Tokenizer.from_file(tokens.byte_bpe())
    lengths = sorted({2048 // k for k in range(1, 2049)}, reverse=True)
    want = Counter()
    for r in mixed:
        ids = np.array([*encode.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        while at < len(ids):
            size = next(n for n in lengths if n <= len(ids) - at)
            want[r.doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)] += 1
            at += size
    assert want == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed)
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    # what isn't filled is less than a hundredth, but for the last sequences of classes
    assert len(sequences) * 2048 * 0.97 < sum(r.length for r in packed) + 40 * 2048


def test_stages_return_documents_only(tables):
    for t in tables[1:5]:
        assert list(t[0].asDict()) == list(DOCUMENT_COLUMNS)
