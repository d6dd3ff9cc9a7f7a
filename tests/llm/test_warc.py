import hashlib
from collections import Counter

import numpy as np
import pytest

from attestor import scratch
from attestor.llm import queries, warc

EMBEDDED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
PAGES = [
    (1, "http://a/", "x" * 99), (2, "http://a/2", "x" * 99), (3, None, "y" * 100), (4, "http://b\r\nX: 1", "y" * 100), (9, "u", "y" * 100),
    (5, "é", None), (6, "u", ""), (7, "u", EMBEDDED * 3), (8, "u", "before " + EMBEDDED + "WARC/1.0\r\n" * 5 + "ünïcode"), (10, "u", EMBEDDED * 3),
    (None, "u", "z" * 200), (11, "u", "z" * 200), (None, "u", "only null" * 50), (12, "u", "\r\n\r\n" * 40), (13, "u", "WARC/1.0\r\n"), (14, "u", "é" * 100_000),
]


def brute(pages):
    first = {}
    for k, _, h in pages:
        h = (h or "").encode()
        if len(h) >= 100 and k is not None:
            first[h] = min(k, first.get(h, k))
    for k, _, h in pages:
        h = (h or "").encode()
        revisit = len(h) >= 100 and h in first and first[h] != k
        yield k, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None


def round_trip(spark, pages, block="128m"):
    path = scratch.new_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, type int").repartition(2), path, records_per_archive=6)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        return [tuple(r) for r in warc.read(spark, path).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block", ["128m", "700b"])
def test_round_trip_with_magic_inside_payloads(spark, block):
    assert Counter(round_trip(spark, PAGES, block)) == Counter(brute(PAGES))


def test_repeated_rows_and_empty(spark):
    rows = [(1, "u", "q" * 150)] * 3 + [(2, "u", "q" * 150)] * 2
    assert Counter(round_trip(spark, rows)) == Counter(brute(rows))
    assert round_trip(spark, []) == []


def test_broken_chain_raises(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n")
    with pytest.raises(Exception, match="chain of records breaks"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_pointer_jumping_equals_a_walk():
    rng = np.random.default_rng(1)
    for _ in range(50):
        start = np.unique(np.append(0, rng.integers(1, 500, 80)))
        following = start + rng.integers(1, 40, len(start))
        seen, at = set(), 0
        while at in set(start.tolist()):
            seen.add(at)
            at = int(following[np.searchsorted(start, at)])
        assert set(start[warc.reachable(start, following)].tolist()) == seen


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op3_warc(spark, "/root/testdata/sf0.001").collect()) == Counter(brute(pages))
