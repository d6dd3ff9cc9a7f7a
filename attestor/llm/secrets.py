"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a document is content-addressed (SHA-256 of its text). The ledger holds the findings for each pair of
blob and rule version; a scan reads only blobs whose pair is missing, each once however many paths hold it, appends
their findings and joins findings back to all paths.

Spans: Spark has no function for the positions of all matches, so each pattern wraps its matches in a marker that no pattern
can match (occurrences in the text are first replaced by another character, one for one); splitting at the marker gives
gaps and matches in turn, whose lengths add up to positions in code points (an interpreted fold over the parts, not generated code).

Rules (fixed by the contract): ``assign``, ``access``, ``hex``; matches are leftmost and non-overlapping for each rule, and one that
is too short is dropped without a second try.

Defined cases: null text is empty; equal texts share a blob; documents are kept row by row, null or repeated ids
too; an empty table gives an empty result and leaves an empty ledger; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestor import scratch
from attestor.llm.filters import marked

RULE_VERSION = "base-1"
#: The kinds in the order that breaks ties of position.
KINDS = ("assign", "access", "hex")
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_VALUE = r"([A-Za-z0-9+/_.=-]++)"
ASSIGN = rf"{_KEYWORD}[\"']?\x20*+[:=]\x20*+[\"']?{_VALUE}"
#: A run of these is one match whether it is long enough or not, so its least length can be part of the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}+", r"[0-9a-f]{16,}+"
_MARK, _OTHER = "\uE000", "\uE001"
OWN = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
SPANS = "array<struct<start:int,rank:int,stop:int>>"


def _positions(text: Column, pattern: str, rank: int, good: Column | None = None) -> Column:
    """Spans of all matches of ``pattern`` in ``text``, which doesn't hold the marker."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,ok:boolean>>")
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("found"))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.char_length(part)
        ok = F.lit(True) if good is None else F.char_length(F.regexp_extract(part, f"^{ASSIGN}$", 1)) >= 12
        one = F.array(F.struct(s["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), ok.alias("ok")))
        return F.struct(end.alias("at"), (~s["odd"]).alias("odd"), F.when(s["odd"], F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    found = F.aggregate(parts, state, step)["found"]
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["rank"], x["stop"]))
    return F.when(F.size(parts) > 1, kept).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """Findings (blob, rule_version, found) of blobs (blob, text); one row each, found may be empty."""
    text = F.translate(F.col("text"), _MARK, _OTHER)
    clean = blobs.select("blob", F.when(F.col("text").contains(_MARK), text).otherwise(F.col("text")).alias("text"))
    spans = [_positions(F.col("text"), p, i, F.lit(True) if p is ASSIGN else None) for i, p in enumerate((ASSIGN, ACCESS, HEX))]
    return clean.select("blob", F.lit(version).alias("rule_version"), F.array_sort(F.concat(*spans)).alias("found"))


def empty_ledger(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"blob binary, rule_version string, found {SPANS}")


def update(docs: DataFrame, ledger: DataFrame | None = None, *, key: str = "doc_id", version: str = RULE_VERSION) -> DataFrame:
    """The findings for those blobs of ``docs`` that ``ledger`` hasn't under ``version``: what is to be appended to it.

    Blobs are counted by their hashes alone. A text that a filter tells not to be new goes at once, and one that another tells to be neither known nor
    repeated is scanned where it is read; only texts that both leave open are brought together by blob (one of each task).
    """
    addressed = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    blobs = addressed.groupBy("blob").agg(F.count("*").alias("n"))
    if ledger is None:
        blobs = blobs.withColumn("known", F.lit(False))
    else:
        seen = ledger.where(F.col("rule_version") == version).select("blob", F.lit(True).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "n", F.coalesce("seen", F.lit(False)).alias("known"))
    blobs = scratch.cut(blobs, "secret-blobs")
    rows = addressed if ledger is None else marked(addressed, blobs.where(~F.col("known")), "blob").where("__hit").drop("__hit")
    rows = marked(rows, blobs.where("n > 1 OR known"), "blob")
    again = rows.where("__hit").select("blob", "text").dropDuplicates(["blob"]).join(blobs.where(~F.col("known")).select("blob"), "blob", "left_semi")
    return scan(rows.where(~F.col("__hit")).select("blob", "text"), version).unionAll(scan(again, version))


def join_back(docs: DataFrame, ledger: DataFrame, *, version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with the findings of their blobs, in the columns OWN."""
    taken = {*OWN, "blob", "found"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    blob = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("blob")
    rows = docs.select(*kept, blob).join(ledger.where(F.col("rule_version") == version).select("blob", "found"), "blob", "left")
    name = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(name, x["rank"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["rank"] == i)).cast("long")
    names = [c for c in docs.columns if c.lower() not in taken]
    return rows.select(*(f"`{c}`" for c in names), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), spans.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


def run(docs: DataFrame, ledger: DataFrame | None = None, *, key: str = "doc_id", version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scans what is new; the documents with their findings, and the whole ledger for the next increment."""
    new = scratch.cut(update(docs, ledger, key=key, version=version), "secret-ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return join_back(docs, whole, version=version), whole
