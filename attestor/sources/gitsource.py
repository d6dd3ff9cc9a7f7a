"""A repository's history as a Spark data source, batch and streaming, and documents as files.

``spark.dataSource.register(GitHistory)``, then ``spark.read.format("git_history").load(repository)``: sha, date, author, subject, body, files
of every commit that isn't a merge. ``spark.readStream`` takes the same options; its offset is a commit, so a run with a checkpoint reads what
was committed since. Repositories are read where tasks run: their path must be the same on all executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as files_of
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "sha string, date string, author string, subject string, body string, files array<string>"
#: No text of a commit can hold a NUL, so none can hold this mark.
_MARK = b"\0\1\0"
_FORMAT = "%x00%x01%x00%H%x00%ad%x00%an%x00%s%x00%b%x00"
_CHUNK = 1 << 20


def _command(path: str, *words: str) -> list[str]:
    return ["git", "-c", "core.fsmonitor=false", "-c", "log.showRoot=true", "-c", "log.showSignature=false", "-C", path, *words]


def _git(path: str, *words: str) -> str:
    done = subprocess.run(_command(path, *words), capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {words[0]} of {path}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode().strip()


@dataclass
class Span(InputPartition):
    """Some commits of a walk from tip, without what since reaches."""

    tip: str
    since: str
    skip: int
    most: int


def _walk(since: str, tip: str) -> list[str]:
    return [tip, f"^{since}"] if since else [tip]


class _History:
    """What both readers share. Only a count reaches the driver, never the commits."""

    def __init__(self, options: dict[str, str]):
        self.path, self.ref, self.each = options["path"].removeprefix("file://"), options.get("ref", "HEAD"), int(options.get("commitsPerPartition", 5000))
        if self.each < 1:
            raise ValueError("commitsPerPartition must be positive")

    def tip(self) -> str:
        """The commit that ref names now; empty where there is none yet."""
        if self.ref == "HEAD" and not _git(self.path, "for-each-ref", "--count=1"):
            return ""
        return _git(self.path, "rev-parse", "--verify", "--quiet", "--end-of-options", self.ref + "^{commit}")

    def spans(self, since: str, tip: str) -> list[Span]:
        if not tip or tip == since:
            return []
        count = int(_git(self.path, "rev-list", "--count", "--no-merges", *_walk(since, tip), "--"))
        return [Span(tip, since, skip, self.each) for skip in range(0, count, self.each)]

    def read(self, partition: Span | None) -> Iterator[tuple]:
        """The span's commits, decoded as git's output arrives. Where there are no spans Spark reads once without one."""
        if partition is None:
            return
        words = ["log", "-z", "--no-merges", "--no-color", "--name-only", "--no-ext-diff", "--no-textconv", "--date=iso-strict", f"--format={_FORMAT}", f"--skip={partition.skip}", f"--max-count={partition.most}"]
        with subprocess.Popen(_command(self.path, *words, *_walk(partition.since, partition.tip), "--"), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            held = b""
            while chunk := run.stdout.read(_CHUNK):
                *whole, held = (held + chunk).split(_MARK)
                yield from map(_commit, filter(None, whole))
            if held:
                yield _commit(held)
        if run.returncode:
            raise ValueError(f"git log of {self.path} ended with {run.returncode}")


def _commit(record: bytes) -> tuple:
    sha, date, author, subject, body, *names = record.decode("utf-8", "replace").split("\0")
    listed = [n for n in (name.removeprefix("\n") if i < 2 else name for i, name in enumerate(names)) if n]
    return sha, date, author.strip(), subject.strip(), body.strip(), listed


class _Batch(_History, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans("", self.tip())


class _Stream(_History, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        return {"commit": self.tip()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Commits that end reaches and start doesn't: each once, also where history was rewritten in between."""
        return self.spans(start["commit"], end["commit"])


class GitHistory(DataSource):
    """Options: path, ref (HEAD), commitsPerPartition (5000). A repository without commits has no rows; a ref that doesn't exist is an error."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many documents it holds: all that the driver learns of them."""

    folder: str
    count: int


class _Documents(DataSourceWriter):
    """Tasks write beside the target; one rename publishes it."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.target, self.overwrite = options["path"].rstrip("/"), overwrite
        self.run = f"{self.target}.{options['run']}"

    def _at(self, path: str) -> tuple[files_of.FileSystem, str]:
        return files_of.FileSystem.from_uri(path)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = f"{self.run}/part-{task.partitionId():05d}.{task.taskAttemptId()}"
        there, path = self._at(folder)
        seen: set[str] = set()
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or "\0" in name or name.startswith("."):
                raise ValueError(f"no file name: {name!r}")
            if name in seen:
                raise ValueError(f"two documents named {name}")
            if not seen:
                there.create_dir(path, recursive=True)
            seen.add(name)
            with there.open_output_stream(f"{path}/{name}") as out:
                out.write((row["text"] or "").encode("utf-8"))
        return Written(folder, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        there, run = self._at(self.run)
        _, target = self._at(self.target)
        there.create_dir(run, recursive=True)
        mine = {self._at(m.folder)[1] for m in messages if m and m.count}
        for entry in there.get_file_info(files_of.FileSelector(run)):  # a folder a task: those of attempts that lost go
            if entry.path in mine:
                there.move(entry.path, entry.path.rsplit(".", 1)[0])
            else:
                there.delete_dir(entry.path)
        old = run + ".old"
        if there.get_file_info(target).type != files_of.FileType.NotFound:
            if not self.overwrite:
                there.delete_dir(run)
                raise ValueError(f"{self.target} is there already")
            there.move(target, old)
        there.move(run, target)
        if there.get_file_info(old).type != files_of.FileType.NotFound:
            there.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        there, run = self._at(self.run)
        if there.get_file_info(run).type != files_of.FileType.NotFound:
            there.delete_dir(run)


class DocumentFiles(DataSource):
    """Sink of (name, text): a file per document, UTF-8 with its line ends as they are, in a folder per task under path."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Documents(self.options, overwrite)


def write_documents(documents: DataFrame, path: str, parts: int, overwrite: bool = False) -> None:
    """Writes (name, text) under path, an absolute path or URI on storage that renames folders and that all executors reach.

    The whole set appears at once or not at all: a failed task, a name that isn't one or that repeats, or a target that is there already (unless
    ``overwrite``) leaves the target as it was. Rows are dealt by name, so a name that repeats meets itself in one task, which holds its own names only.
    A null text is an empty file. A task that outlives its failed job may leave a folder named after the run beside the target; no reader of the target sees it. Readers that list the old set while it is replaced may miss it for the moment between two renames.
    """
    import uuid

    spark = documents.sparkSession
    spark.dataSource.register(DocumentFiles)
    rows = documents.select("name", "text").repartition(parts, "name")
    rows.write.format("document_files").option("path", path).option("run", uuid.uuid4().hex).mode("overwrite" if overwrite else "append").save()
