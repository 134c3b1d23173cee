"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

A document is its ids and a closing id 0; one longer than ``capacity`` is cut into full pieces, the
remainder first. Full pieces are sequences of their own, pieces over half the capacity open one each.

A round ranges over open gaps and waiting pieces together, by size downwards, gaps first at a tie. Going
down, a gap adds one to a level and a piece takes one away; a piece belongs to the gap that last reached
the level it starts from: the smallest gap that holds it and that no piece before it took. Levels come
from ranks: each row has a rank inside its (size, kind, salt) class, and the class counts give every class
its offset. A class has a salt for each ``CLASS_ROWS`` rows of its own, so a size that a third of all pieces
has is ranked by as many tasks as its rows need, and the counts are at most 2 * capacity and one more for each
``CLASS_ROWS`` rows. Rows then meet by level, at most 2 * capacity in one. Gaps are updated and the
round repeats. Where the waiting pieces need more room than the gaps have, or none fits, the largest
open new sequences.

Defined results: null and empty texts are one token (the closing id); repeated rows are packed one by
one; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partflow.llm.shared import release, stored, tidy
from partflow.llm.tokens import BYTE_BPE, encoder
from partflow.llm.words import slices

CAPACITY = 2048
CLASS_ROWS = 1 << 16
PART_ROWS = 1 << 14


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else ():
                ids, ends = code.encode_closed(part.column(1), 0)
                data = memoryview(ids.astype("<u4").tobytes())
                rows, found = [], []
                for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    n = hi - lo
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(i)
                        found.append((k, a, b - a, zlib.crc32(data[4 * (lo + a) : 4 * (lo + b)])))
                piece, start, length, crc = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _sweep(counts: pd.DataFrame, capacity: int) -> tuple[pd.DataFrame | None, int]:
    """Offsets of a round from its class counts (size, kind, salt, n), and how many pieces find a gap.

    An opening piece is left out of the sweep; ``opens`` says how many of a class, by rank, do so.
    """
    counts = counts.sort_values(["size", "kind", "salt"], ascending=[False, True, True]).reset_index(drop=True)
    waiting = counts["kind"].to_numpy() == 1
    n, size = counts["n"].to_numpy(), counts["size"].to_numpy()
    if not waiting.any():
        return None, 0
    smallest = size[waiting].min()
    need, room = int((n * size)[waiting].sum()), int((n * size)[~waiting & (size >= smallest)].sum())

    def opening(k: int) -> np.ndarray:
        before = np.cumsum(np.where(waiting, n, 0)) - np.where(waiting, n, 0)
        return np.where(waiting, np.clip(k - before, 0, n), 0)

    def matches(opens: np.ndarray) -> int:
        free = found = 0
        for gap, c in zip(~waiting, n - opens):
            if gap:
                free += c
            else:
                found += min(free, c)
                free -= min(free, c)
        return int(found)

    opens = opening(max(0, math.ceil((need - room) / capacity)))
    found = matches(opens)
    if not found and not opens.any():
        opens = opening(math.ceil(need / capacity))
    step = np.where(waiting, -(n - opens), n)
    counts = counts.assign(base=np.cumsum(step) - step, opens=opens)
    return counts[["size", "kind", "salt", "base", "opens"]], found


def _round(spark: SparkSession, state: DataFrame, capacity: int, class_rows: int) -> DataFrame | None:
    """One round over gaps (kind 0) and waiting pieces (kind 1), in as many parts as its rows are worth; null when nothing waits."""
    counts = state.groupBy("size", "kind").agg(F.count("*").alias("n")).toPandas()  # at most 2 * capacity rows
    if (counts["n"] > class_rows).any():
        salts = counts.assign(salts=-(-counts["n"] // class_rows)).query("salts > 1")[["size", "kind", "salts"]]
        state = state.join(F.broadcast(spark.createDataFrame(salts)), ["size", "kind"], "left")
        state = state.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        counts = state.groupBy("size", "kind", "salt").agg(F.count("*").alias("n")).toPandas()
    else:
        state, counts = state.withColumn("salt", F.lit(0)), counts.assign(salt=0)
    offsets, _ = _sweep(counts, capacity)
    if offsets is None:
        return None
    ranked = state.withColumn("rank", F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id")))
    ranked = ranked.join(F.broadcast(spark.createDataFrame(offsets)), ["size", "kind", "salt"])
    opens = (F.col("kind") == 1) & (F.col("rank") <= F.col("opens"))
    level = F.when(opens, None).when(F.col("kind") == 0, F.col("base") + F.col("rank")).otherwise(F.col("base") - (F.col("rank") - F.col("opens") - 1))
    ranked = ranked.withColumn("level", level).withColumn("key", F.coalesce("level", F.xxhash64("id")))
    meet = Window.partitionBy("key", F.col("level").isNull()).orderBy(F.desc("size"), "kind")
    before, after = F.lag(F.struct("kind", "id", "used")).over(meet), F.lead(F.struct("kind", "size")).over(meet)
    ranked = ranked.withColumn("before", before).withColumn("after", after)
    matched = F.col("level").isNotNull() & (F.col("before.kind") == 0) & (F.col("kind") == 1)
    taken = F.when(F.col("level").isNotNull() & (F.col("kind") == 0) & (F.col("after.kind") == 1), F.col("after.size")).otherwise(0)
    after = ranked.select(
        "id", "doc", F.when(F.col("kind") == 0, 0).when(F.col("level").isNull(), 2).when(matched, 3).otherwise(1).alias("kind"),
        (F.col("size") - taken).alias("size"), (F.col("used") + taken).alias("used"),
        F.when(matched, F.col("before.id")).otherwise(F.col("id")).alias("seq"), F.when(matched, F.col("before.used")).otherwise(0).alias("offset"),
    )
    return after.coalesce(max(1, int(counts["n"].sum()) // PART_ROWS))


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, text: str = "text", id_col: str = "doc_id", class_rows: int = CLASS_ROWS) -> DataFrame:
    """Every piece with its sequence_id and offset; the pieces of a sequence lie without gaps from 0."""
    spark = documents.sparkSession
    cut = stored(pieces(documents, capacity, tokenizer, text, id_col).withColumn("id", F.monotonically_increasing_id()), "pieces")
    doc = F.struct("doc_id", "piece", "start", "length", "ids_crc32").alias("doc")
    size = F.col("length").cast("int")
    alone = 2 * size > capacity
    placed = [cut.where(alone).select(doc, F.col("id").alias("seq"), F.lit(0).alias("offset"))]
    none = F.lit(None).cast(cut.select(doc).schema["doc"].dataType).alias("doc")
    gaps = cut.where(alone & (size < capacity)).select("id", none, F.lit(0).alias("kind"), (capacity - size).alias("size"), size.alias("used"))
    state = gaps.union(cut.where(~alone).select("id", doc, F.lit(1).alias("kind"), size.alias("size"), F.lit(0).alias("used")))
    while (after := _round(spark, state, capacity, class_rows)) is not None:
        after = stored(after, "round")
        if len(placed) % 8 == 0:
            release(spark)
        placed.append(after.where("kind > 1").select("doc", "seq", "offset"))
        opened = after.where("kind = 2").select("id", none, F.lit(0).alias("kind"), (capacity - F.col("size")).alias("size"), F.col("size").alias("used"))
        state = after.where("kind < 2 AND size > 0").select("id", "doc", "kind", "size", "used").union(opened.where("size > 0"))
    out = placed[0]
    for part in placed[1:]:
        out = out.union(part)
    return out.select("doc.*", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
