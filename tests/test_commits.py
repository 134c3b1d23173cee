"""Polls and tables that change in one commit: failures at every write, changed buckets, levels of folders."""

import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from partflow.operators import catalog, search_index
from partflow.sources import commits
from partflow.sources.commits import Commit, Store, vacuum
from partflow.streaming.settlement import open_store, run_poll

PARTS = "id long, part_number string, quantity int, listed_quantity int, ebay_listing_id string"
LINES = "order_id string, line_id string, listing_id string, quantity int, created timestamp_ntz"
START = datetime(2024, 1, 1)


def at(day):
    return F.lit(datetime(2024, 1, day)).cast("timestamp_ntz")


def opened(spark, folder):
    parts = spark.createDataFrame([(1, "P1", 10, 6, "L1"), (2, "P2", 9, 9, "L2"), (3, "P3", 5, 0, None)], PARTS)
    return open_store(parts, spark.createDataFrame([(START,)], "last_polled_at timestamp_ntz"), folder, buckets=4)


def sold(spark):
    rows = [("1", "1", "L1", 2), ("2", "1", "L2", 1), ("3", "1", "L9", 1), ("4", "1", "L1", 5), ("5", "1", "L1", 4), ("2", "1", "L2", 1)]
    return spark.createDataFrame([(*r, datetime(2024, 1, 1, 1 + n)) for n, r in enumerate(rows)] + [("0", "1", "L1", 1, datetime(2023, 12, 31, 23, 50))], LINES)


def state(spark, folder):
    store = Store(spark, folder)
    return {name: sorted(map(str, store.read(name).collect())) for name in ("parts", "processed", "events", "watermark")}


def test_poll(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    opened(spark, folder)
    poll = run_poll(spark, folder, sold(spark), at(2))
    assert tuple(poll.summary.first()) == (3, 2, 1)
    store = Store(spark, folder)
    assert {r.id: (r.quantity, r.listed_quantity, r.ebay_listing_id) for r in store.read("parts").collect()} == {1: (4, 0, None), 2: (8, 8, "L2"), 3: (5, 0, None)}
    assert sorted((r.part_id, r.quantity_change) for r in store.read("events").collect()) == [(1, -4), (1, -2), (2, -1)]
    assert store.read("watermark").first()[0] == datetime(2024, 1, 2) and store.read("processed").count() == 5
    again = run_poll(spark, folder, sold(spark), at(2))
    assert tuple(again.summary.first()) == (0, 0, 0)


@pytest.fixture(scope="module")
def unfailed(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('polls')}/plain"
    opened(spark, folder)
    before = state(spark, folder)
    run_poll(spark, folder, sold(spark), at(2))
    return before, state(spark, folder)


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("write", range(6))
def test_poll_that_fails_at_any_write_is_repeated(spark, tmp_path, monkeypatch, unfailed, write, late):
    """Before or after each of the five writes and the commit itself: the repeat ends as a poll without failure."""
    folder, calls = f"file://{tmp_path}/failing", []
    before, after = unfailed
    opened(spark, folder)

    def failing(name):
        real = getattr(Commit, name)

        def call(self, *a, **b):
            calls.append(name)
            if len(calls) == write + 1 and not late:
                raise OSError("lost")
            out = real(self, *a, **b)
            if len(calls) == write + 1:
                raise OSError("lost")
            return out

        return call

    with monkeypatch.context() as m:
        m.setattr(Commit, "_write", failing("_write"))
        m.setattr(Commit, "publish", failing("publish"))
        with pytest.raises(OSError):
            run_poll(spark, folder, sold(spark), at(2))
    assert calls[-1] == ("publish" if write == 5 else "_write")
    published = write == 5 and late
    assert (state(spark, folder) == before) != published
    run_poll(spark, folder, sold(spark), at(2))
    assert state(spark, folder) == after


def test_second_writer_of_a_number_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    first, second = Commit(spark, folder), Commit(spark, folder)
    first.replace("t", spark.range(2))
    second.replace("t", spark.range(9))
    first.publish()
    with pytest.raises(Exception, match="FileAlreadyExists"):
        second.publish()
    assert Store(spark, folder).read("t").count() == 2


def test_change_writes_only_its_buckets(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    commit = Commit(spark, folder)
    commit.create("t", spark.range(64_000).selectExpr("id", "id * 7 AS v"), "id", 100)
    old = commit.publish()
    commit = Commit(spark, folder)
    commit.change("t", spark.createDataFrame([(5,), (None,)], "k int"), lambda rows: rows.withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v"))))
    new = commit.publish()
    assert len(set(new.paths("t")) - set(old.paths("t"))) == 1 and len(new.paths("t")) == len(old.paths("t"))

    def size(store, paths):
        return sum(os.path.getsize(f"{d}/{f}") for p in paths for d, _, fs in os.walk(f"{store.folder}/{p}".removeprefix("file://")) for f in fs)

    assert size(new, set(new.paths("t")) - set(old.paths("t"))) < 0.02 * size(old, old.paths("t"))
    assert new.read("t").where("v = -1").count() == 1 and new.read("t").count() == 64_000 and old.read("t").where("v = -1").count() == 0
    with pytest.raises(ValueError, match="outside"):
        Commit(spark, folder).change("t", spark.createDataFrame([(5,)], "k int"), lambda rows: rows.withColumn("id", F.col("id") + 1))


def test_changes_delete_and_add_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    commit = Commit(spark, folder)
    commit.create("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "id", 3)
    keys = spark.createDataFrame([(1,), (7,)], "id long")
    commit.change("t", keys, lambda rows: rows.where("id != 1").unionByName(spark.createDataFrame([(7, "g")], "id long, v string")))
    assert sorted(map(tuple, commit.publish().read("t").collect())) == [(2, "b"), (7, "g")]


def test_appended_folders_are_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "TIER", 3)
    folder = f"file://{tmp_path}/s"
    for n in range(10):
        commit = Commit(spark, folder)
        commit.append("t", spark.range(n, n + 1))
        commit.publish()
    store = Store(spark, folder)
    assert [len(level) for level in store.tables["t"]["levels"]] == [1, 0, 1]
    assert sorted(r.id for r in store.read("t").collect()) == list(range(10))
    assert [r.id for r in Store(spark, folder, 1).read("t").collect()] == [0]
    assert len(vacuum(spark, folder, keep=1, older_than_ms=-1)) == 9 + 12 and Store(spark, folder).read("t").count() == 10


def test_updated_search_index_equals_a_new_one(spark, tmp_path):
    """Numbers that change, come and go: the same finds as an index of the parts as they are, and as a search without one."""
    before = [(i, f"WP{i * 37 % 1000:05d}X") for i in range(120)] + [(200, "A1"), (201, "ABC"), (202, "Z")]
    changed = [(3, "NEW77"), (4, None), (200, None), (201, "AB"), (300, "WP00999Y"), (301, "NEW78")]
    after = [*(r for r in before if r[0] not in {c[0] for c in changed}), *(c for c in changed if c[1])]
    schema = "id long, part_number string"
    asked = spark.createDataFrame([(r,) for r in ("new-77", "wp00999", "WP00037X", "ab", "z", "a1", "9%9", "", "0_9y")], "request string")
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    search_index.build_index(spark.createDataFrame(before, schema), old, 8)
    first = Store(spark, old)
    store = search_index.update_index(spark.createDataFrame(changed, schema), old)
    search_index.build_index(spark.createDataFrame(after, schema), new, 8)
    found = [sorted(map(str, search_index.search_index(asked, spark, f).collect())) for f in (old, new)]
    assert found[0] == found[1] == sorted(map(str, catalog.search_fuzzy(asked, spark.createDataFrame(after, schema)).collect())) and len(found[0]) > 20
    assert sorted(map(tuple, store.read("numbers").collect())) == sorted(after)
    assert set(first.paths("order")) == set(store.paths("order"))


def test_search_in_slices_finds_each_pair_once(spark, monkeypatch):
    """Many slices a gram, terms with wildcards and without three plain characters: the pairs of brute force, each once."""
    monkeypatch.setattr(catalog, "PAIRS", 3)
    numbers = {i: f"WP{i * 37 % 1000:05d}" for i in range(60)} | {100: "A7", 101: "QB9", 102: "Q5B77", 103: "WPWPWP"}
    asked = ["wp00037", "wp0000", "q_b", "q%7", "a%", "a7", "wp", "qb9"]

    def grams(x):
        return {f"  {x} "[i : i + 3] for i in range(len(x) + 1)}

    def like(x, term):
        return re.search(term.replace("%", ".*").replace("_", "."), x) is not None

    words = {r: set().union(*(grams(w) for w in re.split(r"[^a-z0-9]+", r) if w)) for r in asked}
    near = {(r, i): len(words[r] & (b := grams(n.lower()))) / len(words[r] | b) for r in asked for i, n in numbers.items()}
    want = sorted((r, i, s) for (r, i), s in near.items() if s > 0.3 or like(numbers[i].lower(), r))
    parts = spark.createDataFrame(list(numbers.items()), "id long, part_number string")
    got = catalog.search_fuzzy(spark.createDataFrame([(r,) for r in asked], "request string"), parts)
    assert sorted(map(tuple, got.collect())) == want and ("q_b", 102, near["q_b", 102]) in want
