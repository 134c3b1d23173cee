"""Exact token counts by an encoded-length histogram.

Documents are aggregated by encoded length before anything is summed; suffix sums over the histogram
then answer, for every context limit, how many documents and tokens lie at or above it, what is left
when documents are cut there, and which length stands at a quantile. The sums run in two steps, inside
blocks of ``BLOCK`` lengths and over the blocks, so no task sees more rows than a block or the blocks.

Defined results: null and empty texts have 0 tokens and are counted; repeated rows count each; a null
group is a group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from partflow.llm.shared import fresh, stored
from partflow.llm.tokens import BYTE_BPE, encoder
from partflow.llm.words import slices

BLOCK = 512


def encoded_lengths(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """The ``keep`` columns and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, name, 4 << 20) if batch.num_rows else ():
                _, rows = code.encode(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(rows), pa.int64())], names=[*keep, "n_tokens"])

    name = fresh("text", keep)
    source = docs.select(*keep, F.col(text).alias(name))
    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, fields + "n_tokens long")


def length_table(docs: DataFrame, by: tuple[str, ...] = (), text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """One row for each length that occurs (in each group): the answers for a context limit of that length.

    n_docs of exactly this length; docs_from and tokens_from at or above it; docs_over and tokens_over
    above it; tokens_cut, the total when every document is cut there; share, the part of documents of
    this length or less (the smallest length with share >= q is the q-quantile).
    """
    group = F.struct(*by, F.lit(0).alias(fresh("all", by))).alias("group")  # a struct is never null, and clashes with no name below
    hist = encoded_lengths(docs, by, text, tokenizer).select(group, "n_tokens").groupBy("group", "n_tokens").agg(F.count("*").alias("n_docs"))
    hist = stored(hist, "lengths")  # read twice below; the texts are encoded once
    hist = hist.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    up = Window.partitionBy("group").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("group")
    blocks = hist.groupBy("group", "block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = [F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")]
    blocks = blocks.select("group", "block", *above, F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("all"))
    inside = Window.partitionBy("group", "block").orderBy(F.desc("n_tokens"))
    docs_from = F.sum("n_docs").over(inside) + F.col("d_above")
    tokens_from = F.sum("tokens").over(inside) + F.col("t_above")
    out = hist.join(blocks, ["group", "block"]).withColumn("docs_from", docs_from).withColumn("tokens_from", tokens_from)
    over, tokens_over = F.col("docs_from") - F.col("n_docs"), F.col("tokens_from") - F.col("tokens")
    return out.select(
        *(F.col("group")[c].alias(c) for c in by), "n_tokens", "n_docs", "docs_from", "tokens_from", over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("all") - tokens_over + F.col("n_tokens") * over).alias("tokens_cut"), ((F.col("docs") - over) / F.col("docs")).alias("share"),
    )


def cut_totals(table: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(limit, tokens_cut) for any limits, from a length table: of the lengths up to a limit and of what lies over it."""
    asked = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("limit")
    rows = table.select(*by, "n_tokens", "n_docs", asked)
    return rows.groupBy(*by, "limit").agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("tokens_cut"))


def quantiles(table: DataFrame, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(q, n_tokens): the smallest length that at least the share q of documents do not exceed."""
    asked = F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("q")
    return table.select(*by, "n_tokens", "share", asked).where("share >= q").groupBy(*by, "q").agg(F.min("n_tokens").alias("n_tokens"))
