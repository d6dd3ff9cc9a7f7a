"""Index generations: immutable Parquet folders and a small pointer that names the active and the retained ones.

A candidate is written and validated before the pointer moves; readers resolve the pointer once and never see half a generation.
Only the pointer, a few hundred bytes, is handled on the driver; it lives on any Hadoop file system.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from attestor.operators import lifecycle

RETAINED = 2
#: Milliseconds after which a lock is taken to be left over.
STALE_LOCK = 600_000
EMBED_BATCH = 256
#: Layouts that a build can reuse; they change with this module's columns and references.
SCHEMA, PARSER, REFS = "1", "1", "1"
Embedder = Callable[[list[str]], list[list[float]]]
_NAME = re.compile(r"^generation-[0-9a-f]{32}$")


class GenerationError(ValueError):
    pass


def _embedded(passages: DataFrame, embed: Embedder, dimensions: int) -> DataFrame:
    """``passages`` with vector, embedded batch by batch where they are."""
    at = passages.columns.index("text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, EMBED_BATCH):
                batch = whole.slice(start, EMBED_BATCH)
                vectors = [list(map(float, v)) for v in embed(batch.column(at).to_pylist())]
                if len(vectors) != batch.num_rows or any(len(v) != dimensions for v in vectors):
                    raise ValueError("invalid_embedding_output")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "vector"])

    return passages.mapInArrow(work, T.StructType([*passages.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


@dataclass(frozen=True)
class Identity:
    """What two generations must have in common for one to be read, or its vectors reused, under the other's settings."""

    embedding: str
    fingerprint: str = ""
    schema: str = SCHEMA
    parser: str = PARSER
    refs: str = REFS

    def keys(self) -> dict[str, str]:
        digest = hashlib.sha256(self.fingerprint.encode()).hexdigest()
        return {"schema_version": self.schema, "parser_version": self.parser, "ref_version": self.refs, "embedding_identity": self.embedding, "embedding_fingerprint": digest}


class Store:
    """Generations under ``root``; all five keys of ``identity`` (a plain string names the embedding alone) have to match."""

    def __init__(self, spark: SparkSession, root: str, identity: Identity | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.identity = identity if isinstance(identity, Identity) else Identity(identity)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def pointer(self) -> dict:
        """``{"version": 1, "active": name, "retained": [names]}``, strictly checked; empty without one."""
        if not self._fs().exists(self._path("pointer.json")):
            return {"version": 1, "active": None, "retained": []}
        stream = self._fs().open(self._path("pointer.json"))
        raw = bytes(stream.readAllBytes())
        stream.close()
        found = json.loads(raw)
        if set(found) != {"version", "active", "retained"} or found["version"] != 1 or not all(_NAME.match(n) for n in (found["active"], *found["retained"])):
            raise GenerationError("malformed_pointer")
        return found

    def _point(self, active: str, retained: list[str]) -> None:
        body = json.dumps({"version": 1, "active": active, "retained": retained[:RETAINED]}, sort_keys=True).encode()
        temporary = self._path(f".pointer-{uuid.uuid4().hex}")
        out = self._fs().create(temporary, True)
        out.write(bytearray(body))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._path("pointer.json"), options)

    @contextmanager
    def locked(self) -> Iterator[None]:
        """One writer at a time moves the pointer: a file that only one can create, taken over once it is stale."""
        fs, path = self._fs(), self._path(".lock")
        if fs.exists(path) and time.time() * 1000 - fs.getFileStatus(path).getModificationTime() > STALE_LOCK:
            fs.delete(path, False)
        try:
            fs.create(path, False).close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            raise GenerationError("locked") from error
        try:
            yield
        finally:
            fs.delete(path, False)

    def build(self, passages: DataFrame, embed: Embedder | None = None, *, dimensions: int = 0) -> str:
        """Writes a candidate and returns its name; it isn't active yet.

        With ``embed`` (texts of a batch to vectors of ``dimensions`` floats, called in Arrow batches) passages (ref, document_ref, source_hash, text, ...) get
        a vector; those whose document is unchanged take it from the active generation, if that was built under the same identity.
        """
        name, reused = f"generation-{uuid.uuid4().hex}", 0
        if embed is not None:
            active = self.pointer()["active"]
            prior = self.open(active) if active and self._identity(active) == self.identity.keys() else None
            keys = ["ref", "document_ref", "source_hash"]
            if prior is not None and {"vector", *keys} <= set(prior.columns):
                same, new = lifecycle.reusable(passages, prior, keys)
                kept = same.join(prior.select(*keys, "vector"), keys).select(*passages.columns, "vector")
                reused = kept.count()
                passages = kept.unionByName(_embedded(new, embed, dimensions))
            else:
                passages = _embedded(passages, embed, dimensions)
        passages.write.parquet(f"{self.root}/{name}/passages")
        count = self.spark.read.parquet(f"{self.root}/{name}/passages").count()
        row = [(*self.identity.keys().values(), count, reused)]
        self.spark.createDataFrame(row, ", ".join(f"{k} string" for k in self.identity.keys()) + ", passages long, reused long").coalesce(1).write.json(f"{self.root}/{name}/metadata")
        return name

    def metadata(self, name: str | None = None) -> dict:
        """The identity's keys, the number of passages and of those whose vector was reused."""
        name = name or self.pointer()["active"]
        if not name:
            raise GenerationError("no_active_generation")
        return self.spark.read.schema(", ".join(f"{k} string" for k in self.identity.keys()) + ", passages long, reused long").json(f"{self.root}/{name}/metadata").first().asDict()

    def _identity(self, name: str) -> dict[str, str]:
        found = self.metadata(name)
        return {k: found[k] for k in self.identity.keys()}

    def open(self, name: str | None = None) -> DataFrame:
        name = name or self.pointer()["active"]
        if not name:
            raise GenerationError("no_active_generation")
        if self._identity(name) != self.identity.keys():
            raise GenerationError("identity_mismatch")
        return self.spark.read.parquet(f"{self.root}/{name}/passages")

    def validate(self, name: str, expected: DataFrame | None = None, key: str = "ref") -> None:
        """Readable, its keys unique and present and, if given, exactly the expected rows."""
        rows = self.open(name)
        if not rows.groupBy(key).count().where(f"count > 1 OR {key} IS NULL").isEmpty():
            raise GenerationError("duplicate_or_missing_key")
        if expected is not None and not lifecycle.differences(rows, expected).isEmpty():
            raise GenerationError("content_differs")

    def promote(self, name: str, expected: DataFrame | None = None) -> None:
        """Validates a candidate and makes it active; the outgoing one is retained if it is still valid."""
        with self.locked():
            self.validate(name, expected)
            now = self.pointer()
            kept = [n for n in (now["active"], *now["retained"]) if n and n != name and self._valid(n)]
            self._point(name, kept)

    def _valid(self, name: str) -> bool:
        """False for a generation that is unsound or gone; an error of reading it is raised, as it says nothing about the generation."""
        try:
            self.validate(name)
        except GenerationError:
            return False
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def rollback(self) -> str:
        """Back to the newest retained generation that is valid."""
        with self.locked():
            now = self.pointer()
            for i, name in enumerate(now["retained"]):
                if self._valid(name):
                    self._point(name, now["retained"][i + 1 :])
                    return name
        raise GenerationError("no_valid_generation")

    def recover(self) -> str:
        """The active one if it is valid, else the first retained one that is."""
        now = self.pointer()
        return now["active"] if now["active"] and self._valid(now["active"]) else self.rollback()

    def prune(self) -> list[str]:
        """Deletes generations that the pointer doesn't name; folders of any other name are left alone."""
        now = self.pointer()
        named = {now["active"], *now["retained"]}
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path("."))]
        gone = sorted(n for n in found if _NAME.match(n) and n not in named)
        for n in gone:
            self._fs().delete(self._path(n), True)
        return gone

    def report(self) -> DataFrame:
        """What a check-up finds (check, status, detail); nothing is changed: the pointer, the active generation, the retained ones, what pruning would delete."""
        rows = []
        try:
            now = self.pointer()
            rows.append(("pointer", "ok", "absent" if now["active"] is None else "present"))
        except (GenerationError, ValueError) as error:
            return self.spark.createDataFrame([("pointer", "fail", str(error))], "check string, status string, detail string")
        if now["active"] is None:
            rows.append(("active", "fail", "no_active_generation"))
        else:
            for label, name in [("active", now["active"]), *(("retained", n) for n in now["retained"])]:
                try:
                    self.validate(name)
                    rows.append((label, "ok", name))
                except GenerationError as error:
                    rows.append((label, "fail", f"{name}:{error}"))
                except AnalysisException as error:
                    rows.append((label, "fail", f"{name}:{error.getCondition()}"))
        named = {now["active"], *now["retained"]}
        gone = [n for n in (s.getPath().getName() for s in self._fs().listStatus(self._path("."))) if _NAME.match(n) and n not in named]
        rows.append(("unreferenced", "ok" if not gone else "warn", str(len(gone))))
        return self.spark.createDataFrame(rows, "check string, status string, detail string")
