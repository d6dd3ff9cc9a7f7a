"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs in the columns of ``documents``, and returns a DataFrame; all but the last return those columns
again. ``run`` writes each stage's result to the shared folder and rereads it as the next one's docs.

Defined cases, for every stage: further columns of docs are left out, whatever they are called; an empty table gives an empty result; texts of any length are taken
whole. Null and empty texts fail the quality rules; where a later stage is given them, near-duplicates keeps each null text and one empty one, personal data leaves them as they are,
mixing takes no words of them, and packing packs them as the end id alone. Null ids, languages and sources are values like others. Of rows that repeat an id and its text
near-duplicates keeps one; the other stages treat repeated rows as documents of their own. Ties (equal ids with other texts) are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.llm import mixing, neardup, packing, pii, quality, tokens
from attestor.llm.tables import DOCUMENT_COLUMNS, table

#: SQL can express neither the MCD verdicts, nor the sampled candidates, nor the classifier, nor the tokenizer; tests/llm/test_pipeline_brute.py
#: holds each stage against plain Python that shares no code with the operators.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _documents(quality.judge(_documents(docs)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return _documents(neardup.dedupe(_documents(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return _documents(pii.redact(_documents(docs)).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per turn in which the mix takes words of it, its text what is taken in that turn; white space stays as it was."""
    return _documents(mixing.realize(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces in sequences of 2048 ids."""
    return packing.pack(packing.pieces(_documents(docs), tokenizer=tokens.byte_bpe()))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
