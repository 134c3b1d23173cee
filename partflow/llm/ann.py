"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform, on the dimension filled up to a power of two) and assigns each to the nearest signed axis.
A query looks, over all tables together, into the ``probes`` signed axes with its largest coordinates.
Candidates of a bucket are ranked by exact Euclidean distance on the original vectors, in double
precision, and each bucket sends on a query's best ``k``.

Equal vectors are one entry: of their ids only the ``k`` + 1 smallest can ever be returned (ties go to
the smaller id, and a query leaves itself out), so a vector held by a third of all rows is one
candidate. Buckets are cut into blocks of about ``block`` entries by a salt that both sides carry, so no
task holds a bucket of any size. The number of buckets (2 * dimension) is fixed here; for far larger
tables raise ``tables`` and give ``turns`` = 2, which makes a bucket of two signed axes.

Recall measured against brute force at the defaults: README.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part; a query whose probes give fewer than ``k`` is ranked exactly against all
entries, in blocks of both sides, so fewer than ``k`` come back only where fewer candidates exist;
repeated rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from partflow.llm.shared import stored

TABLES = 12
PROBES = 96
BLOCK = 4096


def _signs(dim: int, tables: int, turns: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, turns, 3, dim))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors after one pseudo-rotation, positive axes first, then negative."""
    x = np.zeros((len(unit), signs.shape[1]))
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x = _hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _buckets(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table."""
    out = np.zeros((len(unit), len(signs)), np.int64)
    for t, turns in enumerate(signs):
        for s in turns:
            x = rotated(unit, s)
            out[:, t] = out[:, t] * x.shape[1] + x.argmax(1)
    return out


def _probes(unit: np.ndarray, signs: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its best (table, bucket) codes: those with the largest coordinates over all tables, and its own."""
    scores, codes = [], []
    for t, turns in enumerate(signs):
        first = rotated(unit, turns[0])
        width = first.shape[1]
        if len(turns) == 1:
            score, code = first, np.broadcast_to(np.arange(width), first.shape)
        else:  # two axes: the best few of each, by the sum of their coordinates
            second = rotated(unit, turns[1])
            a, b = np.argsort(-first, 1)[:, :16], np.argsort(-second, 1)[:, :16]
            score = (np.take_along_axis(first, a, 1)[:, :, None] + np.take_along_axis(second, b, 1)[:, None, :]).reshape(len(unit), -1)
            code = (a[:, :, None] * width + b[:, None, :]).reshape(len(unit), -1)
        scores.append(score)
        codes.append(t * (1 << 40) + code)
    score, code = np.concatenate(scores, 1), np.concatenate(codes, 1)
    take = min(probes, score.shape[1])
    best = np.argpartition(-score, take - 1, axis=1)[:, :take]
    own = _buckets(unit, signs) + np.arange(len(signs)) * (1 << 40)
    return np.take_along_axis(code, best, 1), own


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the first ``k`` of each query, ties to the smaller id."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.dropDuplicates(["query_id", "id", "score"]).withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, turns: int = 1, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(query_id, rank, id, score): for each query row its ``k`` nearest of ``vectors`` by Euclidean distance.

    A row of ``vectors`` with the query's own id is left out. ``block`` is about how many vectors of a
    bucket one task ranks at once.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(good)

    base = clean(vectors)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark, columns = vectors.sparkSession, f"query_id long, rank int, {id_col} long, score double"
    if sizes is None:
        return spark.createDataFrame([], columns)
    dim, rows = sizes["d"], sizes["count"]
    base = base.where(F.size("v") == dim)
    salts = max(1, round(rows / (2 * dim) ** turns / block))
    signs = _signs(1 << max(0, dim - 1).bit_length(), tables, turns, seed)

    # Entries: one a distinct vector, with its k + 1 smallest ids, each once (a copy would take a place among k); a salted first step keeps hot vectors spread.
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    few = base.distinct().withColumn("turn", F.row_number().over(salted)).where(F.col("turn") <= k + 1).drop("turn")
    few = few.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("turn") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("v")), "entries")
    asked = clean(queries).where(F.size("v") == dim)
    query_salts = max(1, round(asked.count() * probes / tables / (2 * dim) ** turns / block))

    def unit_rows(batch: pa.RecordBatch, at: int) -> np.ndarray:
        x = _matrix(batch.column(at))
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = _buckets(unit_rows(batch, 0), signs) + np.arange(tables) * (1 << 40)
                back = pa.array(np.repeat(np.arange(batch.num_rows), tables * query_salts))
                salt = np.repeat(batch.column(2).to_numpy() % salts, tables * query_salts) * query_salts + np.tile(np.arange(query_salts), code.size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(code.reshape(-1), query_salts)), pa.array(salt), batch.column(0).take(back), batch.column(1).take(back)], ["code", "salt", "v", "ids"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, own = _probes(unit_rows(batch, 1), signs, probes)
                code = np.concatenate([best, own], 1)
                code.sort(axis=1)
                new = np.concatenate([np.ones((len(code), 1), bool), code[:, 1:] != code[:, :-1]], 1)
                row, at = np.nonzero(new)
                back = np.repeat(row, salts)
                taken = pa.array(back)
                salt = np.tile(np.arange(salts), len(row)) * query_salts + batch.column(0).to_numpy()[back] // 7919 % query_salts
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(code[row, at], salts)), pa.array(salt), batch.column(0).take(taken), batch.column(1).take(taken)], ["code", "salt", "query_id", "q"])

    indexed = entries.select("v", "ids", "entry").mapInArrow(index, "code long, salt long, v array<double>, ids array<bigint>")
    probed = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).mapInArrow(look, "code long, salt long, query_id long, q array<double>")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v, out = np.stack(left["v"].to_numpy()), []
        ids = left["ids"].to_numpy()
        counts = np.array([len(x) for x in ids])
        flat, owner = np.concatenate(ids), np.repeat(np.arange(len(v)), counts)
        for query, q in zip(right["query_id"].to_numpy(), right["q"]):
            gap = v - q
            far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            if len(far) > 2 * k + 2:  # entries at or below the (k + 1)-th distance hold all that can rank
                near = np.flatnonzero(far[owner] <= np.partition(far, k)[k])
            else:
                near = np.arange(len(flat))
            near = near[flat[near] != query]
            near = near[np.lexsort((flat[near], far[owner[near]]))[:k]]
            out.append(pd.DataFrame({"query_id": query, "id": flat[near], "score": far[owner[near]]}))
        return pd.concat(out)

    found = indexed.groupBy("code", "salt").cogroup(probed.groupBy("code", "salt")).applyInPandas(rank, "query_id long, id long, score double")
    found = stored(_best(found, k), "near")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stored(asked.join(full, "id", "left_anti").select(F.col("id").alias("query_id"), F.col("v").alias("q")), "short")
    lacking = short.count()
    if lacking:  # every entry is a candidate of these; both sides are cut into blocks
        entry_blocks, query_blocks = max(1, round(entries.count() / block)), max(1, round(lacking / block))
        zero = F.lit(0).cast("long")
        left = entries.select(F.explode(F.sequence(zero, F.lit(query_blocks - 1).cast("long"))).alias("code"), F.pmod("entry", F.lit(entry_blocks)).alias("salt"), "v", "ids")
        right = short.select(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("code"), F.explode(F.sequence(zero, F.lit(entry_blocks - 1).cast("long"))).alias("salt"), "query_id", "q")
        exact = left.groupBy("code", "salt").cogroup(right.groupBy("code", "salt")).applyInPandas(rank, "query_id long, id long, score double")
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_best(exact, k))
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
