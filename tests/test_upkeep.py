import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from attestor import scratch
from attestor.operators import maintenance as M, research, runs as U, service as S
from attestor.sources import generations, packs
from attestor.sources.policy import Policy, PolicyError


def test_policies_are_loaded_strictly(spark, tmp_path):
    write = lambda text: (tmp_path / "p.yaml").write_text(text) and f"file://{tmp_path}/p.yaml"
    policy = Policy.load(spark, write("version: 1\ninclude: ['*.md']\nexclude: ['draft?.md']\n"))
    assert policy == Policy(("*.md",), ("draft?.md",))
    for text, code in (("version: 2\n", "unsupported_policy"), ("[]", "unsupported_policy"), ("version: 1\ninclude: [1]\n", "invalid_policy_pattern")):
        with pytest.raises(PolicyError, match=code):
            Policy.load(spark, write(text))
    files = spark.createDataFrame([("a.md",), ("draft1.md",), ("x/Personal/a.md",), ("a.txt",), ("../a.md",), ("x/é[1].md",)], "path string")
    assert {r.path for r in policy.discover(files).collect()} == {"a.md", "x/é[1].md"}


def test_a_line_with_other_fields_is_a_corrupt_trail(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    record = spark.range(2).select(*(F.lit(1).cast(f.dataType).alias(f.name) for f in M.AUDIT))
    M.append_audit(record, path)
    assert M.read_audit(spark, path).count() == 2 and M.read_audit(spark, path).columns == [f.name for f in M.AUDIT]
    (tmp_path / "audit" / "more.json").write_text('{"code": "x", "body": "leak"}\n')
    with pytest.raises(Exception, match="corrupt_audit_record"):
        M.read_audit(spark, path).collect()


def test_a_torn_last_line_is_written_again(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id int, t string")
    assert M.append_new(rows.where("id < 3"), path, "id").count() == 3
    (tmp_path / "rows" / "torn.json").write_text('{"id":3,"t":"t3"}\n{"id":4,"t":"t')
    assert {r.id for r in M.append_new(rows, path, "id").collect()} == {4, 5}
    assert M.append_new(rows, path, "id").isEmpty()


def test_question_files_fail_on_malformed_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "a", "query": "q", "language": "en", "type": "x", "ground_truth": {"must_include": ["m"], "acceptable": []}}\n\n')
    (row,) = U.questions(spark, f"file://{tmp_path}/q.jsonl").collect()
    assert (row.id, row.must_include, row.acceptable, row.note) == ("a", ["m"], [], "")
    (tmp_path / "q.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        U.questions(spark, f"file://{tmp_path}/q.jsonl").collect()


def test_tables_cut_leave_no_trace_once_cleared(spark):
    table = scratch.cut(spark.range(5), "t")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with scratch.small_batches(spark, 10), scratch.small_batches(spark, 20):
        assert spark.conf.get(name) == "20"
    assert spark.conf.get(name) == before
    scratch.drop(table)
    with pytest.raises(Exception):
        table.collect()


def test_signed_packs_are_accepted_and_forged_ones_are_not():
    # the first two vectors of RFC 8032, section 7.1
    for secret, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        assert packs.public_key(bytes.fromhex(secret)).hex() == public and packs.sign(bytes.fromhex(secret), bytes.fromhex(message)).hex() == signature
    secret, public = packs.generate_key()
    manifest = packs.signed_manifest(b"pack", "me", secret, "p", "1.0.0")
    packs.check_manifest(b"pack", manifest, {"me": public.hex()}, "p", "1.0.0")
    with pytest.raises(packs.PackError, match="digest_mismatch"):
        packs.check_manifest(b"pack!", manifest, {"me": public.hex()}, "p", "1.0.0")
    with pytest.raises(packs.PackError, match="invalid_signature"):
        packs.check_manifest(b"pack", manifest | {"signature": packs.sign(packs.generate_key()[0], b"x").hex()}, {"me": public.hex()}, "p", "1.0.0")


def test_a_failing_embedder_leaves_its_query_without_a_vector(spark):
    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [None if t == "none" else [1, len(t)] for t in texts]

    rows = S.embedded(spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "none")], "query_id int, text string").coalesce(1), embed).orderBy("query_id").collect()
    assert [(r.vector, r.vector_note) for r in rows] == [([1.0, 2.0], None), (None, "vector_leg_failed:RuntimeError"), (None, "vector_leg_unavailable")]


def test_report_of_a_store(spark, tmp_path):
    store = generations.Store(spark, f"file://{tmp_path}", "m")
    assert [(r.check, r.status) for r in store.report().collect()] == [("pointer", "ok"), ("active", "fail"), ("unreferenced", "ok")]
    one = spark.createDataFrame([("r1", "a")], "ref string, text string")
    for _ in range(2):
        store.promote(store.build(one))
    store.build(one)
    assert [(r.check, r.status) for r in store.report().collect()] == [("pointer", "ok"), ("active", "ok"), ("retained", "ok"), ("unreferenced", "warn")]


def test_bodies_are_inflated_up_to_a_limit(spark):
    bodies = [(b"plain", None), (gzip.compress(b"x" * 90), "GZIP"), (zlib.compress(b"y" * 100), "deflate"), (gzip.compress(b"z" * 5_000_000), "gzip"), (b"p" * 101, ""), (b"not zipped", "gzip"), (b"a", "br"), (gzip.compress(b"cut")[:-4], "gzip"), (None, None)]
    df = spark.createDataFrame([(i, b, e) for i, (b, e) in enumerate(bodies)], "i int, body binary, encoding string")
    # a body of five million bytes is four thousand when it is sent
    got = [(r.x.code, None if r.x.body is None else bytes(r.x.body)) for r in df.select("i", research.bounded_body(100)("body", "encoding").alias("x")).orderBy("i").collect()]
    assert got[:3] == [("ok", b"plain"), ("ok", b"x" * 90), ("ok", b"y" * 100)]
    assert [c for c, _ in got[3:]] == ["raw_bytes_limit_exceeded", "raw_bytes_limit_exceeded", "read_failed", "unsupported_content_encoding", "decompressed_limit_exceeded", "ok"]
    assert df.where("i = 3").select(research.bounded_body(10_000)("body", "encoding").code.alias("c")).first().c == "decompressed_limit_exceeded"


def test_yaml_packs_are_parsed_as_strictly_as_json():
    assert packs.parse(b"a: 2024-01-01\nb: [x, {c: 1}]\n", ".yaml") == {"a": "2024-01-01", "b": ["x", {"c": 1}]}
    for raw, code in ((b"a: 1\na: 2\n", "duplicate_key"), (b"x: {b: 1, b: 2}", "duplicate_key"), (b"a: &x [1]\nb: *x\n", "malformed_pack"), (b"- 1", "malformed_pack"), (b"a: .nan", "malformed_pack"), (b"a: [", "malformed_pack"), (b"? [1]\n: 2\n", "malformed_pack")):
        with pytest.raises(packs.PackError, match=code):
            packs.parse(raw, ".yml")
