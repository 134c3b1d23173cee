"""Running stock of keys that hold more rows than a task should carry.

A row takes what it asks for if that much is left, and nothing else. Rows of a key in order are cut into blocks by range,
and only one number of a block is in question: how much was taken before it. Blocks whose rows, without those that ask for
more than is left, ask for no more than is left in all, are taken whole, so that sums say what is left behind them. The
first block that is not is folded row by row; behind it less is left, which leaves fewer rows that can be taken, and sums
are taken anew. When every block knows where it starts, all blocks are folded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partflow.sources.scratch import stored

HOT_ROWS = 200_000
SHARES = 4


def _hot_keys(rows: DataFrame, key: str, take: str, room: str, hot_rows: int, parts: int) -> dict:
    """Keys with more rows than ``hot_rows`` and than a SHARES-th of a partition's share, and their room: at most SHARES a partition.

    A key where some row asks for less than nothing is not among them: sums do not tell what its blocks take.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(take).alias("least"), F.max(room).alias("room"))
    bound = F.greatest(F.lit(hot_rows), F.floor(counts.agg(F.sum("n")).scalar() / F.lit(SHARES * parts)))
    return {r[0]: r[1] for r in counts.where((F.col("n") > bound) & (F.coalesce("least", F.lit(0)) >= 0) & F.col("room").isNotNull()).select(key, "room").collect()}


def block_starts(rows: DataFrame, key: str, order: tuple[str, ...], take: str, room: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``_block`` and ``_used``: the block of its key that a row stands in, and what the key's rows before that block take.

    ``room`` is what a key has to begin with, the same on all its rows. Keys that are not hot are one block.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_keys(rows, key, take, room, hot_rows, parts)
    one = rows.withColumns({"_block": F.lit(0), "_used": F.lit(0).cast("long")})
    if not hot:
        return one
    kind = rows.schema[key].dataType.simpleString()
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"{key} {kind}"))  # at most SHARES a partition
    ranged = rows.join(keys, key, "left_semi").repartitionByRange(max(parts, SHARES * len(hot)), key, *order).withColumn("_block", F.spark_partition_id())
    table = stored(ranged, "blocks")
    blocks: dict = {}
    for k, b in table.select(key, "_block").distinct().collect():  # a block holds one part of a key, and as many more as it ends in
        blocks.setdefault(k, []).append(b)
    left, start = dict(hot), {}
    pending = {k: sorted(b) for k, b in blocks.items()}
    while pending:
        asked = spark.createDataFrame([(k, b, left[k]) for k, bs in pending.items() for b in bs], f"{key} {kind}, _block int, _left long")
        fits = table.join(F.broadcast(asked), [key, "_block"]).where(F.col(take) <= F.col("_left"))
        sums = {(k, b): n for k, b, n in fits.groupBy(key, "_block").agg(F.sum(take)).collect()}
        edges = []
        for k in list(pending):
            while pending[k]:
                b = pending[k].pop(0)
                start[k, b] = left[k]
                if sums.get((k, b), 0) > left[k]:
                    edges.append((k, b, left[k]))
                    break
                left[k] -= sums.get((k, b), 0)
            if not pending[k]:
                del pending[k]
        edges = [e for e in edges if e[0] in pending]  # what is left behind a key's last block is of no use
        if edges:
            at = spark.createDataFrame(edges, f"{key} {kind}, _block int, _left long")
            rest = table.join(F.broadcast(at), [key, "_block"]).repartition(key).sortWithinPartitions(key, *order).select(key, take, "_left")
            left.update((r[0], r[1]) for r in rest.mapInArrow(_left_behind(key, take), f"{key} {kind}, _left long").collect())
    used = spark.createDataFrame([(k, b, hot[k] - n) for (k, b), n in start.items()], f"{key} {kind}, _block int, _used long")
    split = table.join(F.broadcast(used), [key, "_block"])
    return one.join(keys, key, "left_anti").unionByName(split.select(*one.columns))


def _left_behind(key: str, take: str):
    """What each key's rows, which come in order, leave of ``_left``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, n, room in zip(*(c.to_pylist() for c in batch.columns)):
                room = left.setdefault(k, room)
                if n is not None and n <= room:
                    left[k] = room - n
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(left), kind), pa.array(list(left.values()), pa.int64())], [key, "_left"])

    return run
