import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from attestor.llm import packing, queries, tokens


def encode(texts):
    t = Tokenizer.from_file(tokens.byte_bpe())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def verify(rows, ids, capacity):
    """rows of pieces against the ids of their documents; documents with equal ids may swap places."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, parts in docs.items():
        parts.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in parts)
        assert sum(r.length for r in parts) == copies * len(ids[doc]) and {r.doc_tokens for r in parts} == {len(ids[doc])}
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return 1 - sum(r.length for r in rows) / (capacity * len(sequences))


def test_whole_table_with_little_padding(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = dict(zip(docs, encode(docs.values()), strict=True))
    assert verify(queries.op4_packing(spark, "/root/testdata/sf0.001").collect(), ids, 2048) < 0.02


def test_sequences_hold_every_id_once(spark):
    texts = [None, "", "a b", "long " * 700, "x" * 5000, "<|endoftext|> inside", "don't  stop\n\nnow", "ünï😀"] * 3
    docs = spark.createDataFrame([(i % 8, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    packed = packing.pack(packing.pieces(docs, tokenizer=tokens.byte_bpe(), capacity=64, with_ids=True), capacity=64)
    ids = dict(enumerate(encode(texts[:8])))
    verify(packed.collect(), ids, 64)
    out = packing.sequences(packed).collect()
    got = Counter(i for r in out for i in struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids)))
    assert got == Counter(i for x in ids.values() for i in x * 3)


def test_any_lengths_and_empty(spark):
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "piece long, length long").repartition(5)
    rows = packing.pack(df, capacity=100).collect()
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 100 and len(rows) == 3000
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_cuts_cover_each_length_with_few_pieces():
    table = packing.cuts(2048)
    assert all(sum(p) == n for n, p in enumerate(table))
    assert max(map(len, table)) <= 6
