"""History as a data source, read whole and as it grows, and documents written as files."""

import subprocess

import pytest
from pyspark.sql import functions as F

from attestor.sources import gitlog, gitsource


def git(path, *words, **env):
    who = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@b", "GIT_AUTHOR_DATE": "2024-03-05T10:00:00+02:00", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(path)}
    return subprocess.run(["git", "-C", str(path), *words], check=True, capture_output=True, env=who | env).stdout.decode().strip()


def commit(path, message, **files):
    for name, text in files.items():
        (path / name).write_text(text)
    git(path, "add", "-A")
    git(path, "commit", "-q", "--allow-empty", "-m", message)
    return git(path, "rev-parse", "HEAD")


@pytest.fixture
def repository(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()
    git(path, "init", "-q", "-b", "main")
    return path


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(gitsource.GitHistory)


def history(spark, path, **options):
    return spark.read.format("git_history").options(**options).load(str(path))


def test_commits_in_spans_with_their_files(spark, repository):
    first = commit(repository, "Use a ring: ö\n\nBecause\n\x01 of it\n", **{"b.py": "1", "a é.txt": "2"})
    commit(repository, "No body", c="3")
    git(repository, "checkout", "-q", "-b", "side", first)
    side = commit(repository, "On the side\n\nwhy", d="4")
    git(repository, "checkout", "-q", "main")
    git(repository, "merge", "-q", "--no-ff", "-m", "Merge\n\nnot a decision", "side")
    last = commit(repository, "Nothing touched\n\nbut said")
    for each in (1, 2, 100):
        found = {r.sha: r for r in history(spark, repository, commitsPerPartition=each).collect()}
        assert len(found) == 4 and {first, side, last} < set(found)
    assert tuple(found[first]) == (first, "2024-03-05T10:00:00+02:00", "Ann", "Use a ring: ö", "Because\n\x01 of it", ["a é.txt", "b.py"])
    assert found[last].files == [] and found[side].files == ["d"]
    assert history(spark, repository, commitsPerPartition=1).rdd.getNumPartitions() == 4
    assert {r.sha for r in history(spark, repository, ref="side").collect()} == {first, side}
    rows = history(spark, repository)
    docs = gitlog.documents(rows).collect()
    assert sorted(docs) == sorted(gitlog.documents(rows, rows.select("sha", F.explode("files").alias("file"))).collect())
    assert {d.sha for d in docs} == {first, side, last} and tuple(gitlog.coverage(rows).first()) == (4, 3)
    assert "- `a é.txt`\n- `b.py`\n" in next(d.text for d in docs if d.sha == first)


def test_no_commits_and_no_such_ref(spark, repository):
    assert history(spark, repository).count() == 0
    commit(repository, "One\n\nbody")
    for ref in ("nowhere", "--all"):
        with pytest.raises(Exception, match="rev-parse"):
            history(spark, repository, ref=ref).collect()


def test_stream_reads_only_what_is_new(spark, repository, tmp_path):
    seen = []

    def run():
        out = spark.readStream.format("git_history").option("commitsPerPartition", 2).load(str(repository)).writeStream
        batches = []
        out.foreachBatch(lambda batch, _: batches.extend(r.sha for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        seen.append(sorted(batches))

    some = [commit(repository, f"c{i}\n\nbody") for i in range(3)]
    run()
    more = [commit(repository, f"d{i}\n\nbody") for i in range(3)]
    run()
    run()
    git(repository, "reset", "-q", "--hard", "HEAD~1")  # history is rewritten: what was read isn't read again
    again = commit(repository, "other\n\nbody")
    run()
    assert seen == [sorted(some), sorted(more), [], [again]]


def written(path):
    return {f.name: f.read_bytes().decode() for f in path.rglob("*") if f.is_file()}


def test_documents_appear_all_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(f"2024-01-0{i}-x.md", f"# {i}\r\nline\n") for i in range(1, 9)] + [("empty.md", None)], "name string, text string")
    out = tmp_path / "out"
    gitsource.write_documents(docs.withColumn("extra", F.lit(1)), str(out), 3)
    first = written(out)
    assert first == {r.name: r.text or "" for r in docs.collect()} and all(p.name.startswith("part-") and "." not in p.name for p in out.iterdir())
    for bad in (docs.union(docs.limit(1)), docs.union(spark.createDataFrame([("../up.md", "x")], docs.schema)), docs.union(spark.createDataFrame([(None, "x")], docs.schema)), docs.withColumn("text", F.when(F.col("name") == "empty.md", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))):
        with pytest.raises(Exception, match="two documents|no file name|lost"):
            gitsource.write_documents(bad, str(out), 3, overwrite=True)
        assert written(out) == first and all(p.name.startswith("out.") for p in tmp_path.iterdir() if p != out)  # a task may outlive its job
    with pytest.raises(Exception, match="there already"):
        gitsource.write_documents(docs, str(out), 3)
    gitsource.write_documents(docs.limit(2), str(out), 1, overwrite=True)
    assert len(written(out)) == 2 and not list(tmp_path.glob("*.old"))
    gitsource.write_documents(docs.limit(0), str(tmp_path / "none"), 2)
    assert written(tmp_path / "none") == {} and (tmp_path / "none").is_dir()
