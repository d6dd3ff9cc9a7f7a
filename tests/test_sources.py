import hashlib

import pytest

from attestor.operators import lifecycle
from attestor.sources import generations, gitlog, markdown

DOC = """---
source: git
urls:
- https://a
- ftp://b
- https://a
verified: 2024-05-01
---
intro

# One
text
## Two
```
# not a heading
```
Setext
======
body
## Two
#### Deep
    # code
> # Quoted
#no
<!-- # no -->
"""


def rows(text, path="a/b.md"):
    return list(markdown.passages(path, text.encode()))


def test_headings_paths_lines_and_metadata():
    got = [(r[2], r[3], r[4], r[5]) for r in rows(DOC)]
    assert got == [([], 0, 9, 10), (["One"], 0, 11, 12), (["One", "Two"], 0, 13, 16), (["Setext"], 0, 17, 19), (["Setext", "Two"], 0, 20, 20), (["Setext", "Two", "Deep"], 0, 21, 22), (["Quoted"], 0, 23, 25)]
    assert "".join(r[6] for r in rows(DOC)) == DOC.split("---\n", 2)[2]
    assert '"provenance_urls":["https://a"]' in rows(DOC)[0][7] and '"verification_date":"2024-05-01"' in rows(DOC)[0][7]


def test_refs_are_stable_and_newlines_are_normalized():
    a, b = rows("# T\nx\n# T\ny\n"), rows("# T\r\nx\r\n# T\r\ny\r\n")
    assert a == b and [r[3] for r in a] == [0, 1]
    assert a[1][0] == "chunk:v1:" + hashlib.sha256(b"a/b.md\0T\x001\x000").hexdigest()


def test_documents_without_headings_and_broken_front_matter():
    assert [(r[2], r[4], r[5]) for r in rows("plain\ntext")] == [([], 1, 2)]
    assert rows("") == []
    with pytest.raises(ValueError, match="unterminated"):
        rows("---\na: b\n")


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/n.md").write_text("# A\nhello\n")
    (tmp_path / "other.txt").write_text("# no")
    got = markdown.scan(spark, f"file://{tmp_path}").collect()
    assert [(r.relative_path, r.heading_path, r.text, r.source_hash) for r in got] == [("x/n.md", ["A"], "# A\nhello\n", hashlib.sha256(b"# A\nhello\n").hexdigest())]


def test_git_log(spark, tmp_path):
    log = "\x01\n".join("\0".join(x) for x in [("a" * 40, "2024-01-02", "Ann", "Fix: the Thing!", "because\nso\n"), ("b" * 40, "2024-01-03", "Bo", "no body", ""), ("short", "x")]) + "\x01\n"
    (tmp_path / "log").write_text(log)
    found = gitlog.commits(spark, f"file://{tmp_path}/log")
    files = spark.createDataFrame([("a" * 40, f"f{i:02}") for i in range(20)] * 2, "sha string, file string")
    doc = gitlog.documents(found, files).collect()
    assert [d.name for d in doc] == ["2024-01-02-aaaaaaaa-fix-the-thing.md"] and doc[0].text == (
        "# Fix: the Thing!\n\n**Decided:** 2024-01-02 · **Commit:** `aaaaaaaaaaaa` · **Author:** Ann\n\nbecause\nso\n\n## Files this decision touched\n" + "".join(f"- `f{i:02}`\n" for i in range(12))
    )
    assert tuple(gitlog.coverage(found).first()) == (2, 1)


def test_generations(spark, tmp_path):
    store = generations.Store(spark, f"file://{tmp_path}", "hash-64")
    one = spark.createDataFrame([("r1", "a"), ("r2", "b")], "ref string, text string")
    with pytest.raises(generations.GenerationError):
        store.open()
    names = []
    for i in range(4):
        names.append(store.build(one.selectExpr("ref", f"concat(text, '{i}') AS text")))
        store.promote(names[-1], one.selectExpr("ref", f"concat(text, '{i}') AS text"))
    assert store.pointer() == {"version": 1, "active": names[3], "retained": [names[2], names[1]]}
    assert store.prune() == [names[0]]
    assert store.metadata(names[3])["passages"] == 2
    bad = store.build(one.unionAll(one))
    with pytest.raises(generations.GenerationError, match="duplicate"):
        store.promote(bad)
    assert store.rollback() == names[2] and {r.text for r in store.open().collect()} == {"a2", "b2"}
    with pytest.raises(generations.GenerationError, match="identity"):
        generations.Store(spark, f"file://{tmp_path}", "other").open()
    assert lifecycle.differences(one, one).isEmpty()


def test_incremental_build_embeds_only_what_is_new(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    schema = "ref string, document_ref string, source_hash string, text string"
    one = spark.createDataFrame([(f"r{i}", f"d{i // 2}", f"h{i // 2}", "x" * i) for i in range(10)], schema)
    two = spark.createDataFrame([(f"r{i}", f"d{i // 2}", f"h{i // 2}" if i < 8 else "new", "x" * i) for i in range(12)], schema)
    identity = generations.Identity("model", "weights-1")
    store = generations.Store(spark, f"file://{tmp_path}", identity)
    store.promote(store.build(one, embed, dimensions=2))
    assert store.metadata()["reused"] == 0
    before = calls.value
    name = store.build(two, embed, dimensions=2)
    assert calls.value - before == 4 and store.metadata(name)["reused"] == 8
    store.promote(name)
    assert {(r.ref, tuple(r.vector)) for r in store.open().collect()} == {(f"r{i}", (float(i), 1.0)) for i in range(12)}
    other = generations.Store(spark, f"file://{tmp_path}", generations.Identity("model", "weights-2"))
    assert other.metadata(other.build(two, embed, dimensions=2))["reused"] == 0
    with pytest.raises(Exception, match="invalid_embedding_output"):
        store.build(spark.createDataFrame([("z", "dz", "hz", "t")], schema), lambda texts: [[1.0]], dimensions=2)


def test_pointer_moves_are_locked_and_errors_do_not_drop_generations(spark, tmp_path, monkeypatch):
    store = generations.Store(spark, f"file://{tmp_path}", "hash-64")
    one = spark.createDataFrame([("r1", "a")], "ref string, text string")
    first, second = store.build(one), store.build(one)
    store.promote(first)
    with store.locked():
        with pytest.raises(generations.GenerationError, match="locked"):
            store.promote(second)
    monkeypatch.setattr(store, "validate", lambda name, expected=None, key="ref": (_ for _ in ()).throw(OSError("transient")) if name == first else None)
    with pytest.raises(OSError):
        store.promote(second)
    assert store.pointer()["active"] == first
