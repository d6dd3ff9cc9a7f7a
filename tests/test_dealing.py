"""Rows of a task where a step sorts or groups by a key: bounded by a number, not a share of the input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.operators import dealing
from attestor.plans import catalog, evidence, lifecycle
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "module"), [("evidence_ceiling", lifecycle), ("claim_conflicts", evidence), ("claim_ledger", evidence)])
def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, name, module):
    monkeypatch.setattr(dealing, "ROWS", 400)
    query, limit = getattr(module, name), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = Counter(r.part for r in query(spark, SF).withColumn("part", F.spark_partition_id()).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(parts) >= 12 and max(parts.values()) < 1500
    assert compare(spark, database(SF), name, query, catalog.ORACLES[name], SF)


def test_few_rows_stay(spark):
    rows = spark.range(10)
    assert dealing.dealt(rows, 10, "id") is rows is dealing.dealt(rows, None, "id")
