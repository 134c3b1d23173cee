"""A stored index for fuzzy search: postings, the numbers they stand for, and the order of their grams, in one store.

Numbers lie in buckets by part, postings in buckets by gram. A change of parts reads and writes the buckets of those parts
and of their old and new grams, in one commit. The order of grams is taken when the index is built and kept: a search
needs the same order on both sides, not the true one, so an update gives the same finds as a new index. When stock has
changed much, build it anew for speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partflow.operators.catalog import gram_order, part_postings, search_postings
from partflow.sources.commits import BUCKETS, Commit, Store
from partflow.sources.scratch import stored


def build_index(parts: DataFrame, folder: str, buckets: int = BUCKETS) -> Store:
    """The index of parts (id, part_number), each id once, as the next state of ``folder``."""
    commit = Commit(parts.sparkSession, folder)
    order = commit.replace("order", gram_order(parts))
    commit.create("numbers", parts.select("id", "part_number"), "id", buckets)
    commit.create("postings", part_postings(commit.after.read("numbers"), order), "gram", buckets)
    return commit.publish()


def update_index(changed: DataFrame, folder: str) -> Store:
    """The index after changes (id, part_number; null: the part is gone), each id once."""
    spark, commit = changed.sparkSession, Commit(changed.sparkSession, folder)
    changed = stored(changed.select("id", "part_number"), "changed")
    order, ids, kept = commit.before.read("order"), changed.select("id"), changed.where("part_number IS NOT NULL")
    old = commit.before.read("numbers").join(ids, "id", "left_semi")
    new = stored(part_postings(kept, order), "postings")
    grams = part_postings(old, order).select("gram").unionByName(new.select("gram"))
    commit.change("numbers", ids, lambda rows: rows.join(ids, "id", "left_anti").unionByName(kept))
    commit.change("postings", grams, lambda rows: rows.join(ids, "id", "left_anti").select(*new.columns).unionByName(new))
    return commit.publish()


def search_index(requests: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(request, id, similarity) of requests, as ``catalog.search_fuzzy`` gives them for the parts of the index."""
    store = Store(spark, folder)
    return search_postings(requests, store.read("postings"), store.read("order"))
