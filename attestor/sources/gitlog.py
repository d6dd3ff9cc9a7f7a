"""Commit history to markdown documents: a text scan split at the log's separators.

Expects ``git log --no-merges --format='%H%x00%ad%x00%an%x00%s%x00%b%x01' --date=iso-strict``, one or many files of it;
``gitsource`` reads the same from a repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.functions import text as T

# Fixed values of the generated documents.
BODY_CAP, FILES_LISTED = 16_000, 12


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, date, author, subject, body) of records with all five fields."""
    rows = spark.read.option("lineSep", "\x01").text(path).select(F.split("value", "\0", -1).alias("f")).where(F.size("f") >= 5)
    part = lambda i: F.trim(F.get("f", F.lit(i)))
    return rows.select(F.regexp_replace(part(0), r"^\s+", "").alias("sha"), part(1).alias("date"), part(2).alias("author"), part(3).alias("subject"), F.regexp_replace(F.get("f", F.lit(4)), r"^\s+|\s+$", "").alias("body"))


def documents(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Commits with a body as documents: name and text. ``files`` (sha, file) lists what they touched; without it, a column files does, if there is one."""
    rows = found.where(F.length("body") > 0)
    if files is None and "files" in rows.columns:
        rows = rows.withColumn("files", F.slice(F.array_sort(F.array_distinct("files")), 1, FILES_LISTED))
    elif files is not None:
        rows = rows.drop("files")
        listed = files.groupBy("sha").agg(F.slice(F.array_sort(F.collect_set("file")), 1, FILES_LISTED).alias("files"))
        rows = rows.join(listed, "sha", "left")
    else:
        rows = rows.withColumn("files", F.lit(None).cast("array<string>"))
    name = F.concat(F.concat_ws("-", F.substring("date", 1, 10), F.substring("sha", 1, 8), T.slug(F.col("subject"))), F.lit(".md"))
    touched = F.coalesce(F.array_join(F.transform("files", lambda f: F.concat(F.lit("- `"), f, F.lit("`\n"))), ""), F.lit(""))
    decided = F.concat(F.lit("**Decided:** "), F.substring("date", 1, 10), F.lit(" · **Commit:** `"), F.substring("sha", 1, 12), F.lit("` · **Author:** "), "author")
    text = F.concat(F.lit("# "), F.col("subject"), F.lit("\n\n"), decided, F.lit("\n\n"), F.substring("body", 1, BODY_CAP), F.lit("\n\n## Files this decision touched\n"), touched)
    return rows.select("sha", name.alias("name"), text.alias("text"))


def coverage(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("examined"), F.count_if(F.length("body") > 0).alias("written"))
