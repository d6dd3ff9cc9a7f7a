"""Token counts by a separator scan of flat token files.

Writing: a document's ids as big-endian unsigned integers of 16 bits (32 for larger vocabularies), then the end-of-document id. Files carry no index.
Spark's text sink writes them as raw bytes with the bytes of the end id as its line separator; that id (50304 or 0xF48FBFBF, above any vocabulary of that
width) is chosen so that its bytes are also the UTF-8 form of one character, which is what the sink asks of a separator.

Reading: files (of a bounded number of documents) are dealt in blocks of ``BLOCK`` bytes. Each block is searched for the end id at
once; it reports its number of ids, its first and last end id and the counts between. A prefix scan over a file's blocks (the
last end id before the block, the number of end ids before it) stitches documents that cross blocks; it runs over a few rows per file.

As files hold no names, a document is known by its task and place; whoever puts names to them can compare the bytes that its ids stand for (n_bytes) with those
of the text, so rows in another order don't go unnoticed.

A file of more than 2 GB can't be read back: ``docs_per_file`` bounds it, and has to be lowered for documents of over 100,000 ids on average.

Defined cases: null text has no ids and counts 0; repeated rows are separate documents; what follows a file's last end id is a document
that isn't closed; an empty table gives an empty result; further columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attestor.llm import tokens

#: Type of an id and the end id, by whether ids are wide.
END_ID, WIDE_END_ID = 50_304, 0xF48FBFBF
LAYOUT = {False: (np.dtype(">u2"), END_ID), True: (np.dtype(">u4"), WIDE_END_ID)}
DOCS_PER_FILE = 20_000
BLOCK = 4 << 20


def write(docs: DataFrame, path: str, *, tokenizer: str, text: str = "text", docs_per_file: int = DOCS_PER_FILE, wide: bool = False) -> None:
    """Writes the documents to the folder ``path``: task n writes files part-n, in the order of its rows."""

    kind, end_id = LAYOUT[wide]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        for batch in batches:
            rows = []
            for t in batch.column(0):
                ids = np.frombuffer(encode(t.as_py() or ""), "<u4")
                if len(ids) and ids.max() >= end_id:
                    raise ValueError(f"id {ids.max()} doesn't fit below the end id {end_id}")
                rows.append(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    flat = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(work, "ids binary")
    flat.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end_id.to_bytes(kind.itemsize, "big").decode()).option("maxRecordsPerFile", docs_per_file).text(path)


SEARCHED = "file string, block int, ids long, ends long, first long, last long, between array<long>, all_bytes long, first_bytes long, last_bytes long, between_bytes array<long>"


def searcher(tokenizer: str | None, wide: bool):
    """Per block (file, block, bytes): ids, end ids, the first and the last of them (-1: none), the counts between; and the same in bytes that ids stand for."""
    kind, end_id = LAYOUT[wide]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tokens.encoder(tokenizer).lengths if tokenizer else np.zeros(1, "i8")
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), kind)
                end = ids == end_id
                at = np.flatnonzero(end)
                size = np.cumsum(np.where(end, 0, lengths[np.minimum(ids, len(lengths) - 1)]))
                some = len(at) > 0
                row = (
                    len(ids), len(at), int(at[0]) if some else -1, int(at[-1]) if some else -1, (np.diff(at) - 1).astype("i8"),
                    int(size[-1]), int(size[at[0]]) if some else 0, int(size[at[-1]]) if some else 0, np.diff(size[at]),
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.int64()] * 3, pa.list_(pa.int64())]
            names = [c.split()[0] for c in SEARCHED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return search


def counts(spark: SparkSession, path: str, *, tokenizer: str | None = None, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """Per document: part (the task that wrote it), nth (its place among the part's documents), file, start (ids before it in the file), n_tokens, n_bytes, closed.

    n_bytes is 0 without a tokenizer.
    """
    if block % LAYOUT[wide][0].itemsize:
        raise ValueError("a block is a whole number of ids")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length").where("length > 0")
    cut = files.select("file", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block).cast("int"))).alias("block"))
    cut = cut.select("file", "block", F.substring("content", F.col("block") * block + 1, F.lit(block)).alias("bytes"))
    found = cut.mapInArrow(searcher(tokenizer, wide), SEARCHED)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("ends") > 0
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    found = found.withColumn("base", upto("ids")).withColumn("base_bytes", upto("all_bytes")).withColumn("nth", upto("ends"))
    found = found.withColumn("last_end", F.when(ended, F.col("base") + F.col("last"))).withColumn("last_end_bytes", F.when(ended, F.col("base_bytes") + F.col("last_bytes")))
    # where the document begins that is open at the block's start
    found = found.withColumn("open", F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).withColumn("open_bytes", F.coalesce(F.max("last_end_bytes").over(before), F.lit(0)))
    found = found.withColumn("blocks", F.count("*").over(Window.partitionBy("file")))
    rest = F.col("base") + F.col("ids") - F.coalesce(F.col("last_end") + 1, F.col("open"))
    rest_bytes = F.col("base_bytes") + F.col("all_bytes") - F.coalesce("last_end_bytes", "open_bytes")
    tail = (F.col("block") == F.col("blocks") - 1) & (rest > 0)
    none = F.array().cast("array<long>")

    def lengths(crossing: Column, between: str, left: Column) -> Column:
        return F.concat(F.coalesce(F.concat(F.when(ended, F.array(crossing)), F.col(between)), none), F.when(tail, F.array(left)).otherwise(none))

    n = lengths(F.col("base") + F.col("first") - F.col("open"), "between", rest)
    n_bytes = lengths(F.col("base_bytes") + F.col("first_bytes") - F.col("open_bytes"), "between_bytes", rest_bytes)
    docs = found.select("file", "nth", "ends", F.posexplode(F.arrays_zip(n.alias("n"), n_bytes.alias("b"))).alias("i", "x"))
    docs = docs.select("file", (F.col("nth") + F.col("i")).alias("d"), F.col("x.n").alias("n_tokens"), F.col("x.b").alias("n_bytes"), (F.col("i") < F.col("ends")).alias("closed"))
    # the start of each document: lengths and end ids since the file's
    first = Window.partitionBy("file").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.coalesce(F.sum(F.col("n_tokens") + 1).over(first), F.lit(0)))
    docs = docs.withColumn("part", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")).withColumn("piece", F.coalesce(F.nullif(F.regexp_extract("file", r"-c(\d+)(?:\.[^/.]+)*$", 1), F.lit("")).cast("int"), F.lit(0)))
    per_file = docs.groupBy("part", "piece").agg(F.count("*").alias("docs"))
    earlier = per_file.withColumn("shift", F.coalesce(F.sum("docs").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return docs.join(earlier.select("part", "piece", "shift"), ["part", "piece"]).select("part", (F.col("d") + F.col("shift")).alias("nth"), "file", "start", "n_tokens", "n_bytes", "closed")
