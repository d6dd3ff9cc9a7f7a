"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing: a record is ``WARC/1.0`` CRLF, header lines, an empty line, the block and CRLF CRLF. The text sink takes the
whole of it as one row and CRLF CRLF as its line separator, so archives are written by tasks with the usual commit protocol.
Of records whose payloads are equal and have ``REVISIT_MIN`` bytes or more, that with the smallest page_id is a response and
the others are revisits without payload.

Reading: the text source splits archives at every ``WARC/1.0`` CRLF, in blocks that tasks read independently. Each
occurrence is only a *candidate* record start, as payloads may hold the magic too. A candidate's header gives its
successor's offset. Per archive (its size is bounded when it is written) pointer jumping from offset 0 keeps the candidates
that are reachable; every other one lies inside a payload. Payloads that hold the magic are put together from their
pieces; all others are digested where they are read and never shuffled.

Defined cases: null html is an empty payload; null url leaves the header out, line breaks in it are percent-encoded; a null
page_id is read back as null and never becomes the one that others refer to, unless all are null; rows that repeat both
page_id and payload get the same type (a repeated response stays a response); an empty table gives an empty result; further columns
of the input are ignored. An archive whose chain doesn't end exactly at its end raises, so nothing is lost silently.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.llm.filters import marked

MAGIC, BREAK, END = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
REVISIT_MIN = 100
#: Records an archive holds at most; it bounds what one task resolves.
RECORDS_PER_ARCHIVE = 20_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def write(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Writes an archive record per row of ``pages`` (page_id, url, html) to the folder ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    digest = F.sha2(F.col("html"), 256).alias("digest")
    seen = rows.where(F.octet_length("html") >= REVISIT_MIN).groupBy(digest).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.cut(seen.where("n > 1").select("digest", "first"), "warc-firsts")
    # a payload that can't be a repeated one isn't moved, however many digests repeat
    told = marked(rows.withColumn("digest", digest), firsts, "digest")
    alone = told.where(~F.col("__hit")).drop("__hit").withColumn("first", F.lit(None).cast("long"))
    typed = told.where("__hit").drop("__hit").join(firsts, "digest", "left").select(*alone.columns).unionAll(alone)
    typed = typed.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    block = F.when(F.col("revisit"), F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    typed.select(
        F.concat(
            F.lit(MAGIC),
            F.when(F.col("revisit"), F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
            F.lit(f"WARC-Date: {date}\r\n"),
            _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
            _line("WARC-Target-URI", F.col("url")),
            F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(BREAK)),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK)),
            F.lit(BREAK),
            block,
        ).alias("value")
    ).write.option("lineSep", END).option("maxRecordsPerFile", records_per_archive).text(path)
    scratch.drop(firsts)


def _field(head: Column, name: str, value: str = "[^\r\n]*") -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*({value})[ \t]*$", 1), F.lit(""))


def _page(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*<urn:page:(-?[0-9]{{1,19}})>[ \t]*$", 1), F.lit("")).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two occurrences of the magic: file, start of the block read, order in it and the bytes themselves."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("nth"), F.col("value"),
    )


def _payload(block: Column) -> Column:
    """The bytes after the HTTP header of a block."""
    return F.substring(block, F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END) + 1, 2**31 - 1)


RECORD = "file string, first_nth long, head_bytes long, block_bytes long, type string, page_id long, refers_to long, payload_bytes long, payload_digest string, nths array<long>"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per piece with its header's fields; the payload's length and digest as far as this one piece holds it."""
    pieces = _pieces(spark, path)
    head = F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1))
    rows = pieces.withColumn("head", head).withColumn("head_bytes", F.octet_length("head").cast("long"))
    rows = rows.withColumn("block_bytes", _field(F.col("head"), "Content-Length", "[0-9]{1,18}").cast("long")).withColumn("type", F.lower(_field(F.col("head"), "WARC-Type")))
    rows = rows.withColumn("block", F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + len(END) + 1).cast("int"), F.least(F.col("block_bytes"), F.lit(2**31 - 1)).cast("int")))
    payload = _payload(F.col("block"))
    return rows.select(
        "file", "block_start", "nth", F.octet_length("value").cast("long").alias("piece_bytes"), "head_bytes", "block_bytes", "type",
        _page(F.col("head"), "WARC-Record-ID").alias("page_id"), _page(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "revisit", _field(F.col("head"), "WARC-Payload-Digest", "sha256:[0-9a-f]{64}").substr(8, 64)).otherwise(F.sha2(payload, 256)).alias("payload_digest"),
    )


def reachable(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Pointer jumping: which of the sorted offsets ``start`` a chain of successors from offset 0 visits."""
    n = len(start)
    at = np.searchsorted(start, successor)
    found = (at < n) & (start[np.minimum(at, n - 1)] == successor) & (successor > start)
    jump = np.append(np.where(found, at, n), n)
    mark = np.zeros(n + 1, bool)
    mark[np.searchsorted(start, 0)] = True
    while (jump[:n] < n).any():
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["block_start", "nth"], ignore_index=True)
    magic = len(MAGIC)
    size = pdf.piece_bytes.to_numpy("i8") + magic
    offset = np.cumsum(size) - size - magic  # of the magic before each piece; the first piece has none
    end = int(size.sum()) - magic
    if end == 0:
        return pdf.head(0).assign(first_nth=0, nths=None)[[c.split()[0] for c in RECORD.split(", ")]]
    ok = (pdf.head_bytes.notna() & pdf.block_bytes.notna()).to_numpy() & (offset >= 0)
    length = pdf.head_bytes.fillna(0).to_numpy("i8") + pdf.block_bytes.fillna(0).to_numpy("i8") + magic + 2 * len(END)
    rows = np.flatnonzero(ok)
    start, following = offset[rows], (offset + length)[rows]
    if not len(rows) or start[0] != 0:
        raise ValueError(f"{pdf.file[0]} doesn't begin with a record")
    kept = rows[reachable(start, following)]
    if offset[kept[-1]] + length[kept[-1]] != end:
        raise ValueError(f"{pdf.file[0]}: the chain of records breaks after offset {offset[kept[-1]]}")
    out = pdf.iloc[kept].assign(first_nth=pdf.nth.to_numpy()[kept])
    upto = np.append(kept[1:], len(pdf))
    nth = pdf.nth.to_numpy()
    out["nths"] = [nth[a:b].tolist() if b - a > 1 else None for a, b in zip(kept, upto, strict=True)]
    return out[[c.split()[0] for c in RECORD.split(", ")]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = scratch.cut(candidates(spark, path), "warc-candidates")
    records = scratch.cut(found.groupBy("file").applyInPandas(_chain, RECORD), "warc-records")
    # payloads that hold the magic, from their pieces: the archive is read again, only those pieces are shuffled
    inside = records.where("nths IS NOT NULL AND type <> 'revisit'").select("file", "first_nth", "head_bytes", "block_bytes", F.explode("nths").alias("nth"))
    inside = scratch.cut(inside, "warc-inside")
    parts = _pieces(spark, path).join(inside, ["file", "nth"]).groupBy("file", "first_nth").agg(
        F.first("head_bytes").alias("head_bytes"), F.first("block_bytes").alias("block_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), MAGIC).alias("value"),
    )
    block = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("block_bytes").cast("int"))
    whole = parts.select("file", "first_nth", _payload(block).alias("payload")).select("file", "first_nth", F.octet_length("payload").cast("long").alias("whole_bytes"), F.sha2("payload", 256).alias("whole_digest"))
    records = records.join(whole, ["file", "first_nth"], "left").select(
        "page_id", "type", "refers_to", F.coalesce("whole_bytes", "payload_bytes").alias("own_bytes"), F.coalesce("whole_digest", "payload_digest").alias("payload_digest")
    )
    lengths = records.where((F.col("type") == "response") & (F.col("own_bytes") >= REVISIT_MIN)).groupBy(F.col("payload_digest")).agg(F.min("own_bytes").alias("first_bytes"))
    revisits = records.where("type = 'revisit'").join(lengths, "payload_digest", "left")
    out = lambda df, size: df.select("page_id", F.col(size).alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), "refers_to")
    return out(records.where("type <> 'revisit'"), "own_bytes").unionByName(out(revisits, "first_bytes"))
