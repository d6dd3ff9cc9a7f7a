import numpy as np
import pytest

from attestor import scratch
from attestor.llm import queries, tokenfiles, tokens


@pytest.mark.parametrize("block", [tokenfiles.BLOCK, 6, 2])
def test_documents_across_blocks_and_files(spark, block):
    texts = [None, "", "a b c d e f", "", "word " * 50, '"' * 9, "Ā" * 5, "x"] * 4
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, nth int").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    path = scratch.new_path(spark, "test-tokens")
    df = scratch.cut(df, "test-docs")
    tokenfiles.write(df, path, tokenizer=tokens.byte_bpe(), docs_per_file=4)
    encode = tokens.encoder(tokens.byte_bpe())
    rows = sorted(tokenfiles.counts(spark, path, block=block).collect(), key=lambda r: (r.part, r.nth))
    order = sorted(df.selectExpr("text", "spark_partition_id() AS part", "monotonically_increasing_id() AS m").collect(), key=lambda r: r.m)
    assert [(r.part, r.n_tokens, r.closed) for r in rows] == [(o.part, len(encode(o.text or "")) // 4, True) for o in order]
    told = sorted(tokenfiles.counts(spark, path, block=block, tokenizer=tokens.byte_bpe()).collect(), key=lambda r: (r.part, r.nth))
    assert [r.n_bytes for r in told] == [len((o.text or "").encode()) for o in order] and [r.n_tokens for r in told] == [r.n_tokens for r in rows]
    starts = {}
    for r in rows:
        assert r.start == starts.get(r.file, 0)
        starts[r.file] = r.start + r.n_tokens + 1


def test_unclosed_and_empty(spark, tmp_path):
    (tmp_path / "part-00000-x-c000.txt").write_bytes(np.array([5, tokenfiles.END_ID, 7, 8], ">u2").tobytes())
    rows = tokenfiles.counts(spark, f"file://{tmp_path}").collect()
    assert sorted((r.nth, r.n_tokens, r.closed) for r in rows) == [(0, 1, True), (1, 2, False)]
    path = scratch.new_path(spark, "test-tokens")
    tokenfiles.write(spark.createDataFrame([], "text string"), path, tokenizer=tokens.byte_bpe())
    assert tokenfiles.counts(spark, path).count() == 0


def test_query(spark):
    encode = tokens.encoder(tokens.byte_bpe())
    docs = {r.doc_id: len(encode(r.text)) // 4 for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op2_tokencounts(spark, "/root/testdata/sf0.001").collect()} == docs


@pytest.mark.parametrize("block", [4, 4096])
def test_wide_ids_and_a_file_name_that_looks_like_a_piece(spark, tmp_path, block):
    """Two files of one task, whose common name holds "-c123" as the names that Spark makes up may."""
    for piece, ids in enumerate(([5, 70_000, tokenfiles.WIDE_END_ID, tokenfiles.WIDE_END_ID], [1, tokenfiles.WIDE_END_ID, 2, 3, 4, tokenfiles.WIDE_END_ID])):
        (tmp_path / f"part-00000-1b2c3d4e-c123-4abc-9def-0123456789ab-c{piece:03}.txt").write_bytes(np.array(ids, ">u4").tobytes())
    rows = tokenfiles.counts(spark, f"file://{tmp_path}", block=block, wide=True).collect()
    assert sorted((r.part, r.nth, r.n_tokens, r.closed) for r in rows) == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 1, True), (0, 3, 3, True)]


def test_wide_files_round_trip_with_very_long_and_special_texts(spark):
    texts = ["word " * 300_000, "<|endoftext|> inside", None, "é😀" * 50, "word " * 300_000]
    path = scratch.new_path(spark, "test-tokens")
    df = scratch.cut(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "test-docs")
    tokenfiles.write(df, path, tokenizer=tokens.byte_bpe(), wide=True)
    rows = sorted(tokenfiles.counts(spark, path, tokenizer=tokens.byte_bpe(), wide=True, block=1 << 20).collect(), key=lambda r: r.nth)
    encode = tokens.encoder(tokens.byte_bpe())
    assert [(r.n_tokens, r.n_bytes) for r in rows] == [(len(encode(t or "")) // 4, len((t or "").encode())) for t in texts]
