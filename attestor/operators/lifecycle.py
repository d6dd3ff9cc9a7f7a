"""Set operators of the index's life: what can be reused, what is valid, what is unreferenced, who answers what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.operators.dealing import dealt


def reusable(new: DataFrame, old: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` whose keys ``old`` holds too (nulls equal), and those that have to be made again."""
    a, b = new.alias("a"), old.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_semi"), a.join(b, same, "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, repeats counted: empty iff they are equal."""
    names = a.columns
    both = a.withColumn("__n", F.lit(1)).unionByName(b.select(*names).withColumn("__n", F.lit(-1)))
    out = both.groupBy(*names).agg(F.sum("__n").alias("surplus")).where("surplus <> 0")
    return out.withColumn("side", F.when(F.col("surplus") > 0, "left").otherwise("right")).withColumn("surplus", F.abs("surplus"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def resolve_aliases(refs: DataFrame, aliases: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(ref, resolved): an alias's target, else the reference itself; null under a tombstone."""
    dead = tombstones.select("ref").distinct().withColumn("dead", F.lit(True))
    rows = refs.join(aliases.select("ref", "target"), "ref", "left").join(dead, "ref", "left")
    return rows.select("ref", F.when(F.col("dead").isNull(), F.coalesce("target", "ref")).alias("resolved"))


def first_of_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def independence(commit_login: Column, issue_login: Column, commit_name: Column, authored: Column, created: Column, is_pull: Column) -> Column:
    """Why a commit and an issue aren't independent (null: they are): a pull request, the same author, or an issue as young as the commit."""
    name, login = F.lower(commit_name), F.lower(issue_login)
    parts = F.filter(F.split(name, "[^a-z0-9]+"), lambda p: F.length(p) > 2)
    same = F.replace(name, F.lit(" "), F.lit("")).contains(login) | F.exists(parts, lambda p: login.contains(p))
    known = commit_login.isNotNull() & (commit_login != "")
    return (
        F.when(is_pull, "pull_request").when(known & (F.lower(commit_login) == login), "same_author").when(~known & same, "same_name")
        .when(created >= authored, "issue_not_earlier")
    )


def answers(pairs: DataFrame) -> DataFrame:
    """The earliest commit that answers each issue; the others are listed after it. ``pairs``: issue, authored_at, sha."""
    order = F.array_sort(F.collect_list(F.struct("authored_at", "sha")))
    rows = pairs.groupBy("issue").agg(order.alias("c"))
    return rows.select("issue", F.get("c", F.lit(0))["sha"].alias("sha"), F.transform(F.slice("c", 2, 2**30), lambda x: x["sha"]).alias("also_answered_by"))


def acknowledgments(required: Column, offered: Column) -> Column:
    """What is missing and what is superfluous."""
    return F.struct(F.array_except(required, offered).alias("missing"), F.array_except(offered, required).alias("unexpected"))


def ceiling(legs: list[DataFrame], most: int, by: str, number: int | None = None) -> DataFrame:
    """Evidence legs (by, pos, ref) one after the other, the first ``most`` of each request, repeats of a reference left out.

    ``number``: of the legs' rows, if it is known; by it requests are dealt to tasks.
    """
    rows = legs[0].withColumn("leg", F.lit(0))
    for i, leg in enumerate(legs[1:], 1):
        rows = rows.unionByName(leg.withColumn("leg", F.lit(i)))
    once = dealt(rows, number, by).groupBy(by, "ref").agg(F.min(F.struct("leg", "pos")).alias("o"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("o", "ref"))).where(F.col("rank") <= most).select(by, "ref", "o.leg", "rank")


def layered_digest(rows: DataFrame, by: str, line: Column, count: str, name: str) -> DataFrame:
    """A digest per ``by`` over all lines of rows (key, line: a struct in the order of lines): lines are hashed in order within 65,536 buckets by the key's
    own hash, then the buckets' digests in order. What a task gathers is a bucket's lines, or 65,536 digests.
    """
    dealt = rows.withColumn("bucket", F.substring(F.sha2("key", 256), 1, 4))
    per = dealt.groupBy(by, "bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("m"))
    per = per.select(by, "bucket", "n", F.sha2(F.array_join("m.text", ""), 256).alias("h"))
    out = per.groupBy(by).agg(F.sum("n").alias(count), F.array_sort(F.collect_list(F.concat("bucket", "h"))).alias("m"))
    return out.select(by, count, F.sha2(F.array_join("m", ""), 256).alias(name))
