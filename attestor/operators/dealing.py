"""Steps that sort or group by a key in as many tasks as their rows need: the memory of a task then stays the same as the input grows, whatever the session's number of shuffle partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task.
ROWS = 1 << 18


def dealt(rows: DataFrame, number: int | None, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` if their ``number`` (of which a rough figure will do) asks for more tasks than the session has shuffle partitions; joins, groups and windows by the keys stay with it."""
    held = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-(number or 0) // ROWS)
    return rows.repartition(parts, *keys) if parts > held else rows
