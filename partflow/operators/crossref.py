"""Mining of cross-references from search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partflow.functions.text import classify_relationship, mine_mentions
from partflow.sources.tables import insert_absent


def mine_cross_refs(results: DataFrame, parts: DataFrame, min_mentions: int = 2) -> DataFrame:
    """Numbers mentioned beside a part at least ``min_mentions`` times, with the first mention's URL and relationship.

    Mentions are counted, not pages. "First" is by query, rank and place in the text. Hits are dealt by part once: they
    meet the part's number by hashing, and are sorted there alone, to be counted.
    """
    numbers = parts.select(F.col("id").alias("part_id"), "part_number", "part_number_raw")
    text = F.concat_ws(" ", "title", "description")
    hits = results.join(numbers.hint("shuffle_hash"), "part_id").select("*", F.posexplode(mine_mentions(text)).alias("pos", "mention")).where("mention != part_number")
    order = F.struct("query_no", "rank", "pos", "url", "description")
    first = F.min_by(F.struct("url", classify_relationship(F.col("description"), F.col("part_number_raw")).alias("relationship")), order)
    counted = hits.groupBy("part_id", F.col("mention").alias("cross_ref_part_number")).agg(first.alias("first"), F.count("*").alias("mentions"))
    return counted.where(F.col("mentions") >= min_mentions).select("part_id", "cross_ref_part_number", "first.relationship", F.col("first.url").alias("source_url"), "mentions")


def refresh(xrefs: DataFrame, results: DataFrame, parts: DataFrame) -> DataFrame:
    """The cross-references with those mined that are not there yet."""
    mined = mine_cross_refs(results, parts).select(*xrefs.columns)
    return insert_absent(xrefs, mined, ["part_id", "cross_ref_part_number"])
