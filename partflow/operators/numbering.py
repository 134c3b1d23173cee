"""Consecutive positions over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from partflow.sources.scratch import stored

_AT = (1 << 33) - 1  # the part of monotonically_increasing_id that counts the rows of a partition


def numbered(df: DataFrame, order: str, tie: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``position`` 1, 2, ... by ``order``, then ``tie``.

    Rows are dealt by ranges of both and written down sorted, with their place inside their range; what is left to know
    is how many rows stand in the ranges before, one count a range (``blocks``; null: as many as a shuffle has
    partitions). Readers of the result read what was written.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(blocks, order, tie).sortWithinPartitions(order, tie)
    table = stored(dealt.select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit(_AT)).alias("_at")), "numbered")
    counts = table.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_block", before.alias("_before"))  # at most ``blocks`` rows
    return table.join(F.broadcast(offsets), "_block").withColumn("position", F.col("_at") + 1 + F.col("_before")).drop("_block", "_at", "_before")
