"""Evaluation runs: question files, answers in an index, identity reranks, gate matrices, scale figures, checks of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

QUESTION = "id string, query string, language string, type string, ground_truth struct<must_include: array<string>, acceptable: array<string>>, note string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A file of JSON lines, blank ones skipped; a malformed line fails the read."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    return rows.select("id", "query", "language", "type", "ground_truth.must_include", "ground_truth.acceptable", F.coalesce("note", F.lit("")).alias("note"))


def first_correct(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, top1, first_correct_rank) from a ranking (query_id, document, rank) and truth (query_id, document), which may have several rows."""
    top = ranking.groupBy("query_id").agg(F.min_by("document", "rank").alias("top1"))
    hit = ranking.join(truth, ["query_id", "document"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_correct_rank"))
    return truth.select("query_id").distinct().join(top, "query_id", "left").join(hit, "query_id", "left")


def answer_present(truth: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, present): whether the index holds a document of the answer's name at all."""
    held = names.select("document").distinct().withColumn("here", F.lit(True))
    return truth.join(held, "document", "left").groupBy("query_id").agg(F.max(F.coalesce("here", F.lit(False))).alias("present"))


def answer_rank(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank) of the answer in the whole document order of a ranking of passages (query_id, document, rank); null if it isn't ranked.

    The rank is one more than the number of documents whose best passage comes first, so nothing is sorted.
    """
    best = ranking.groupBy("query_id", "document").agg(F.min("rank").alias("best"))
    own = truth.join(best, ["query_id", "document"], "left").groupBy("query_id").agg(F.min("best").alias("own"))
    return best.join(own, "query_id", "right").groupBy("query_id", "own").agg(F.count_if(F.col("best") < F.col("own")).alias("n")).select("query_id", F.when(F.col("own").isNotNull(), F.col("n") + 1).alias("rank"))


def membership(plain: DataFrame, staged: DataFrame) -> DataFrame:
    """(query_id, dropped, added): documents (query_id, document) that only one of two result sets holds, in order."""
    both = plain.select("query_id", "document", F.lit(1).alias("p"), F.lit(0).alias("s")).unionAll(staged.select("query_id", "document", F.lit(0), F.lit(1)))
    sides = both.groupBy("query_id", "document").agg(F.max("p").alias("p"), F.max("s").alias("s"))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("document"))))
    return sides.groupBy("query_id").agg(names((F.col("p") == 1) & (F.col("s") == 0)).alias("dropped"), names((F.col("p") == 0) & (F.col("s") == 1)).alias("added"))


def identity_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows (dropped, added, plain_rank, staged_rank, plain_documents, staged_documents) what a stage that should change nothing has changed."""
    both = F.col("plain_rank").isNotNull() & F.col("staged_rank").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if((F.size("dropped") > 0) | (F.size("added") > 0)).alias("membership_changed"), F.count_if(F.col("plain_rank").isNotNull() & F.col("staged_rank").isNull()).alias("answers_dropped"),
        F.count_if(both & (F.col("plain_rank") != F.col("staged_rank"))).alias("rank_moved"), F.avg("plain_documents").alias("plain_documents"), F.avg("staged_documents").alias("staged_documents"),
    )


def restated(shipped: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of two rankings holds, duplicates counted: empty if a restatement agrees."""
    return shipped.select(*keys).exceptAll(again.select(*keys)).withColumn("side", F.lit("shipped")).unionAll(again.select(*keys).exceptAll(shipped.select(*keys)).withColumn("side", F.lit("restated")))


def gates(cells: DataFrame, *by: str) -> DataFrame:
    """passed, failed and not_validated cells (status)."""
    return cells.groupBy(*by).agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "not_validated").alias("not_validated"))


def scale(timings: DataFrame, by: str) -> DataFrame:
    """p50 (median) and p95 (the element at int(n * 0.95) in order) of ms per size."""
    rows = timings.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy("ms")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.median("ms").alias("p50"), F.max(F.when(F.col("i") == F.floor(F.col("n") * 0.95), F.col("ms"))).alias("p95"))


def unrepresented(passages: DataFrame, documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Passages (ref, document_ref, path, source_hash) that don't come back through documents and manifest with the same fields: empty for a sound index."""
    back = passages.join(documents.select("document_ref").distinct(), "document_ref", "left_semi").join(manifest.select("path").distinct(), "path", "left_semi")
    return passages.join(back.select("ref"), "ref", "left_anti")


def heading_path(raw: Column) -> Column:
    """A JSON list of strings as an array; null for anything else, never a plausible-looking path."""
    only_strings = raw.rlike(r'^\s*\[\s*("(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*)?\s*\]\s*$')  # from_json would also take numbers and objects
    return F.when(only_strings, F.from_json(raw, "array<string>"))


def cursors(pages: DataFrame) -> DataFrame:
    """Cursors (cursor, request_id, ref) decoded: position, and code where one isn't JSON or was made for another request or reference."""
    standard = F.translate(F.col("cursor"), "-_", "+/")
    valid = F.col("cursor").rlike(r"^[A-Za-z0-9_-]+={0,2}$") & (F.length("cursor") % 4 == 0)
    body = F.from_json(F.when(valid, F.unbase64(standard).cast("string")), "request_id string, ref string, position long")
    rows = pages.withColumn("body", body)
    code = F.when(F.col("body").isNull() | F.col("body.position").isNull(), "malformed_cursor").when(~F.col("body.request_id").eqNullSafe(F.col("request_id")) | ~F.col("body.ref").eqNullSafe(F.col("ref")), "cursor_mismatch")
    return rows.select(*pages.columns, F.when(code.isNull(), F.col("body.position")).alias("position"), code.alias("code"))


def cursor(request_id: Column, ref: Column, position: Column) -> Column:
    """A URL-safe cursor of canonical JSON."""
    body = F.to_json(F.struct(position.alias("position"), ref.alias("ref"), request_id.alias("request_id")))
    return F.translate(F.regexp_replace(F.base64(body.cast("binary")), "[\r\n]", ""), "+/", "-_")


def notes(ranking: DataFrame) -> DataFrame:
    """(query_id, document, rank, via): documents in the order of their best passage (query_id, document, rank, via), labelled by the leg that found it."""
    best = ranking.groupBy("query_id", "document").agg(F.min(F.struct("rank", "via")).alias("b"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("b.rank", "document"))
    return best.select("query_id", "document", place.alias("rank"), F.col("b.via").alias("via"))


def report(summary: DataFrame, order: str) -> DataFrame:
    """A summary as the lines of a markdown table (line, text): a heading, a rule and a line per row, in ``order``; null is a dash."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    names = summary.columns
    head = summary.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("line"), row([F.lit(c) for c in names]).alias("text")), F.struct(F.lit(1).alias("line"), row([F.lit("---")] * len(names)).alias("text")))).alias("x")).select("x.*")
    place = F.row_number().over(Window.orderBy(order)) + 1  # a summary has few rows
    return head.unionByName(summary.select(place.alias("line"), row([F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]).alias("text")))
