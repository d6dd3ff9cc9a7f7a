"""Keeps a passage store up to date with documents that arrive: incremental, by a file stream with a checkpoint.

Documents (doc_id, text, source) come as Parquet files in a folder. A run takes the files that no earlier run has taken, in micro-batches, and writes

    <output>/documents  source=…/batch=…   a row per version of a document: references, hash, language, tokens, advisories, number of passages
    <output>/passages   source=…/batch=…   its text in windows of ``passage_characters`` code points, each with a content-addressed reference

A document that is delivered again with the text it has already is left out; another text is a new version, which replaces the old one in ``current``.
A batch that is run again after a failure sees the same files and the same earlier batches, and overwrites its own partitions: the result is that of one
run. Of a batch's rows of one document the one in the latest file counts. The store's texts aren't read for that: the join takes
references and hashes of the batch's sources only.

Defined cases: a null text is empty and has no passages; a document without id goes by its text's hash; a null source is "unknown"; further columns are left out; an
empty folder adds nothing. The checkpoint belongs to the output (``<output>/_checkpoint``): both start anew together.

    spark-submit --py-files … jobs/passage_store.py --config jobs/passage_store.json --documents <folder> --output <folder>
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as Y

from attestor.functions import text as T

log = logging.getLogger("jobs.passage_store")

DEFAULTS = {"documents": None, "output": None, "passage_characters": 2000, "files_per_batch": 1000}
DOCUMENT = "doc_id long, document_ref string, source_hash string, language string, n_tokens long, n_passages long, advisories array<string>, source string, batch long"
PASSAGE = "doc_id long, document_ref string, ref string, ordinal int, start long, stop long, language string, n_tokens long, text string, source string, batch long"
UNKNOWN = "unknown"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first batch has written it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _latest(versions: DataFrame) -> DataFrame:
    """(document_ref, batch, source_hash) of each document's newest version."""
    return versions.groupBy("document_ref").agg(F.max("batch").alias("batch"), F.max_by("source_hash", "batch").alias("source_hash"))


PLACE = ["__at", "__file", "__row"]


def versions(docs: DataFrame) -> DataFrame:
    """Documents with reference and hash, and the place of each row among the files."""
    text, at = F.coalesce(F.col("text"), F.lit("")), F.col("_metadata")
    rows = docs.select(
        "doc_id", text.alias("text"), F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.sha2(text, 256).alias("source_hash"),
        at["file_modification_time"].alias("__at"), at["file_path"].alias("__file"), at["row_index"].alias("__row"),
    )
    name = F.concat_ws("/", "source", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.col("source_hash")), F.lit(".md")))
    return rows.withColumn("document_ref", T.digest("doc:v1:", name))


def fresh(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Places of the rows to store: the last one of each reference, unless the store has its text already. No text is moved for that."""
    last = rows.groupBy("document_ref").agg(F.max(F.struct(*PLACE, "source_hash")).alias("last")).select("document_ref", "last.*")
    return last.join(_latest(earlier), ["document_ref", "source_hash"], "left_anti").select(*PLACE)


def described(rows: DataFrame, passage_characters: int) -> DataFrame:
    """Versions with what the store tells of a document."""
    return rows.select(
        "doc_id", "document_ref", "source_hash", T.language(F.col("text")).alias("language"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"),
        F.ceil(F.length("text") / passage_characters).alias("n_passages"), T.advisories(F.col("text")).alias("advisories"), "source",
    )


def passages(rows: DataFrame, passage_characters: int) -> DataFrame:
    """Versions as windows of whole texts, each with its reference."""
    count = F.ceil(F.length("text") / passage_characters).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    parts = rows.select("doc_id", "document_ref", "source", "source_hash", "text", F.explode(starts).alias("ordinal"))
    at = F.col("ordinal").cast("long") * passage_characters + 1
    parts = parts.select("doc_id", "document_ref", "source", "source_hash", "ordinal", at.alias("start"), F.substring(F.col("text"), at.cast("int"), F.lit(passage_characters)).alias("text"))
    ref = T.digest("chunk:v1:", F.col("document_ref"), F.col("source_hash"), F.col("ordinal").cast("string"))
    return parts.select(
        "doc_id", "document_ref", ref.alias("ref"), "ordinal", "start", (F.col("start") + F.length("text") - 1).alias("stop"), T.language(F.col("text")).alias("language"),
        F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), "text", "source",
    )


def run(spark: SparkSession, documents: str, output: str, passage_characters: int = 2000, files_per_batch: int = 1000) -> dict[str, Any]:
    """Takes what is new in ``documents`` into the store at ``output``; the number of batches, rows read, documents and passages written."""
    schema = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("text", Y.StringType()), Y.StructField("source", Y.StringType())])
    done = {"batches": 0, "rows": 0, "documents": 0, "passages": 0}
    tables = {"documents": (described, DOCUMENT), "passages": (passages, PASSAGE)}

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        mine = batch.persist()  # read twice; a lost block is read from its file again
        try:
            rows = versions(mine)
            sources = [r[0] for r in rows.select("source").distinct().collect()]  # as many rows as sources
            earlier = _stored(session, f"{output}/documents", DOCUMENT).where(F.col("source").isin(sources) & (F.col("batch") < number))
            kept = fresh(rows, earlier).persist()
            read, new = mine.count(), kept.count()
            if new < read:  # else all rows stay where they are
                rows = rows.join(kept, PLACE, "left_semi")
            for table, (made, kind) in tables.items() if new else ():
                made_rows = made(rows, passage_characters).withColumn("batch", F.lit(number).cast("long")).hint("rebalance", "source")
                # a batch's partitions are its own: one that runs again replaces what it has left
                made_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(f"{output}/{table}")
                written = _stored(session, f"{output}/{table}", kind).where(F.col("batch") == number).count()
                done[table] += written
                log.info("batch %d: %d rows of %s written to %s", number, written, table, output)
            kept.unpersist()
            done["rows"] += read
            done["batches"] += 1
            log.info("batch %d: %d rows read from %s", number, read, documents)
        finally:
            mine.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(documents)
    stream = stream.select("doc_id", "text", "source", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("_metadata"))
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{output}/_checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%s: %s", documents, done)
    return done


def current(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The newest version of each document in the store, and its passages."""
    told = _stored(spark, f"{output}/documents", DOCUMENT)
    newest = _latest(told).select("document_ref", "batch")
    return told.join(newest, ["document_ref", "batch"], "left_semi"), _stored(spark, f"{output}/passages", PASSAGE).join(newest, ["document_ref", "batch"], "left_semi")


if __name__ == "__main__":
    from jobs.command import main

    main(run, DEFAULTS, "passage store")
