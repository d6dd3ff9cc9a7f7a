import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from attestor.llm import bestfit, queries, tokens

SF = "/root/testdata/sf0.001"


def library():
    return Tokenizer.from_file(tokens.word_bpe())


def brute(lengths, capacity):
    """Number of sequences of best-fit decreasing, a piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def places(runs):
    """(length, rank) to (sequence, offset)."""
    return {(r.length, r.first + i): (r.sequence + i // r.per, r.offset + i % r.per * r.length) for r in runs for i in range(r.pieces)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.sampled_from([40, 41, 64, 100]))
def test_plan_equals_best_fit_piece_by_piece(lengths, capacity):
    at = places(bestfit.plan(Counter(lengths), capacity))
    assert len(at) == len(lengths)
    fill = defaultdict(list)
    for (n, _), (sequence, offset) in at.items():
        fill[sequence].append((offset, n))
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(fill) == brute(lengths, capacity) and sorted(fill) == list(range(len(fill)))


def test_plan_is_small_whatever_the_counts():
    rng = np.random.default_rng(5)
    counts = {n: int(c) for n, c in zip(range(1, 2049), rng.integers(1, 10**9, 2048), strict=True)}
    runs = bestfit.plan(counts, 2048)
    assert len(runs) < 100_000 and sum(r.pieces for r in runs) == sum(counts.values())
    with pytest.raises(ValueError):
        bestfit.plan({2049: 1}, 2048)
    assert bestfit.plan({}, 2048) == []


def verify(rows, ids, capacity):
    """``ids``: those of each document, in any number of copies."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, parts in docs.items():
        want = Counter()
        for own in ids[doc]:
            for i, at in enumerate(range(0, len(own), capacity)):
                want[i, at, len(own[at : at + capacity]), zlib.crc32(np.array(own[at : at + capacity], "<u4").tobytes())] += 1
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == want
    assert docs.keys() == ids.keys()
    for parts in sequences.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    return len(sequences)


def test_whole_table_in_as_few_sequences_as_best_fit_needs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: [[*e.ids, 0]] for r, e in zip(docs, library().encode_batch([r.text or "" for r in docs], add_special_tokens=False), strict=True)}
    rows = queries.op12_bestfit(spark, SF).collect()
    lengths = [r.length for r in rows]
    got = verify(rows, ids, 2048)
    assert got == brute(lengths, 2048) and got <= 1.05 * sum(lengths) / 2048 + 1


def test_nulls_ties_repeats_very_long_texts_and_clashes(spark):
    texts = [None, "", "A b's", "word " * 3000, "word " * 3000, "x" * 4000, "<|endoftext|> inside", "ünï😀 é İΣ"]
    rows = [(i % 5 if i else None, t, 9, "c") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, __nth string").repartition(3)
    packed = bestfit.pack(bestfit.pieces(df, tokenizer=tokens.word_bpe(), capacity=128, with_ids=True), capacity=128)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    ids, t = defaultdict(list), library()
    for doc, text, *_ in rows:
        ids[doc].append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    got = packed.collect()
    verify(got, ids, 128)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    empty = bestfit.pack(bestfit.pieces(df.limit(0), tokenizer=tokens.word_bpe()))
    assert empty.count() == 0 and empty.columns[-2:] == ["sequence_id", "offset"]


def test_one_length_with_a_third_of_all_rows(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a a a a a a' ELSE repeat('a ', cast(1 + id % 37 AS int)) END AS text").repartition(7)
    rows = bestfit.pack(bestfit.pieces(df, tokenizer=tokens.word_bpe(), capacity=64), capacity=64).collect()
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert len(rows) == 9000 and len({(r.sequence_id, r.offset) for r in rows}) == 9000 and max(fill.values()) <= 64
    assert len(fill) <= 1.01 * sum(r.length for r in rows) / 64 + 1


def test_word_ids_equal_the_library():
    encode, t, rng = tokens.word_encoder(tokens.word_bpe()), library(), random.Random(7)
    letters = "ab'sStTrevmld 19.,-Äß€ſŁıĳ\t\nЖё漢한ア!‐…²½ªº×÷́ Σ\x01\x02😀"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    tokens_ = [k.removesuffix("</w>") for k in t.get_vocab() if k.isascii() and k.removesuffix("</w>").islower()]
    texts += ["".join(rng.choices(tokens_, k=rng.randint(1, 5))) for _ in range(20_000)] + ["x" * 10_000, "ab" * 40 + " " + "cd" * 40]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.ids, text


def test_word_ids_stay_the_same_when_the_kept_ones_go(monkeypatch):
    encode, t = tokens.WordEncoder(tokens.word_bpe()), library()
    monkeypatch.setattr(tokens.WordEncoder, "KEPT", 3)
    for i in range(50):
        text = f"some words {i} again, some other{i} words"
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
