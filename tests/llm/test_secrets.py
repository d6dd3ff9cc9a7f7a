import hashlib
import re

from hypothesis import HealthCheck, given, settings, strategies as st

from attestor.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(rows):
    for r in rows:
        assert r.spans == brute(r.text), r.text
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in r.spans.split(",")) for k in secrets.KINDS]


TRICKY = [
    None, "", "token: token = abcdefghijklmnop", 'API_KEY = "abc.def=ghi/jkl+mno"', "password==abcdefghijkl", "secret:short", "AKIAKIA" + "A" * 20,
    "AKIA" + "B" * 13, "AKIA" + "B" * 14, "0123456789abcdef", "0123456789abcde", "𝔘𝔫 token=0123456789abcdef0  é token=abcdefabcdefabcdef",
    "x" * 100_000 + " secret=" + "f" * 50_000, "" * 3, "token=abc token=abcdefghijklm",
]


def test_tricky_texts_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TRICKY + TRICKY)], "doc_id long, text string, blob string")
    found, ledger = secrets.run(docs)
    rows = found.collect()
    assert len(rows) == 2 * len(TRICKY) and "blob" not in found.columns
    check(rows)
    assert ledger.count() == len({t or "" for t in TRICKY})


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdefghijklmn"), (2, "plain")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "plain"), (4, "secret=abcdefghijklmn"), (5, "token=abcdefghijklmn")], "doc_id long, text string")
    _, ledger = secrets.run(first)
    assert secrets.update(second, ledger).count() == 1
    assert secrets.update(second, ledger, version="base-2").count() == 3
    found, whole = secrets.run(second, ledger)
    check(found.collect())
    assert whole.count() == 3


def test_empty_table(spark):
    found, ledger = secrets.run(spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and ledger.count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["token", "api_key", "'", '"', " ", "=", ":", "abc", "0123456789ab", "AKIA", "ZZZZZZZZZ", "é", "\n", "SeCrEt"]), max_size=25).map("".join), min_size=1, max_size=60))
def test_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(secrets.run(docs)[0].collect())


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op10_secrets(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.spans for r in rows} == {k: brute(t) for k, t in texts.items()}
