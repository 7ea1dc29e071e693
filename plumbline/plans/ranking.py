"""Numbering all rows of a table in an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.scratch import scratch


def numbered(rows: DataFrame, name: str, *order: str | Column, first: int = 1) -> DataFrame:
    """rows with their place in the order as a long column: a range sort, a count of each partition, and each partition's offset.

    The order must be total for places to be certain. What is numbered is checkpointed: a range is cut by a sample, and a second
    pass, or a lost executor's, might cut it elsewhere.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(rows.sparkSession))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut.withColumns({"rank_part": F.spark_partition_id(), "rank_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    sizes = {r["rank_part"]: r["count"] for r in placed.groupBy("rank_part").count().collect()}  # a row for each partition
    offsets, at = [], first
    for part in range(n):
        offsets.append(at)
        at += sizes.get(part, 0)
    start = F.element_at(F.lit(offsets), F.col("rank_part") + 1)
    return placed.withColumn(name, (start + F.col("rank_row")).cast("long")).drop("rank_part", "rank_row")
