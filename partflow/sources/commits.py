"""One commit for several tables.

A store is a folder. Data files are written first, each write to a folder of its own that nobody reads yet; a commit
is one small file with the next number that names, for every table, the folders it consists of. It is written beside
its place and moved there without overwriting, so it is seen whole or not at all, and of two writers of one number the
second fails. A job that fails anywhere before leaves the store as it was, and its repeat starts from the same state;
the folders it has left are named by no commit and go by ``vacuum``.

Tables come in two forms. A keyed table lies in hash buckets, and a change writes the buckets that hold its keys and
keeps the others' folders. An appended table is a list of folders by levels: ``TIER`` folders of a level become one of
the next, so the list stays short and a row is rewritten once a level.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
TIER = 16
_COMMITS = "_commits"


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """The Hadoop file system of a path, the path, and the configuration."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place, conf


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """What stands in a folder: names and times of change; nothing where the folder is not there."""
    fs, place, _ = _file_system(spark, path)
    return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(place)] if fs.exists(place) else []


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class Store:
    """What the last commit of a folder names, or the one with the given number."""

    def __init__(self, spark: SparkSession, folder: str, number: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        known = [int(n.removesuffix(".json")) for n, _ in _names(spark, f"{self.folder}/{_COMMITS}") if n[:1].isdigit()]
        self.number = max(known, default=0) if number is None else number
        self.tables: dict[str, dict[str, Any]] = {}
        if self.number:
            self.tables = json.loads(spark.read.text(self.place(self.number), wholetext=True).first()[0])

    def place(self, number: int) -> str:
        return f"{self.folder}/{_COMMITS}/{number:010d}.json"

    def paths(self, name: str, buckets: list[int] | None = None) -> list[str]:
        """The folders of a table, or of some of its buckets."""
        table = self.tables[name]
        if "buckets" in table:
            return [table["folders"][b] for b in sorted(table["folders"]) if buckets is None or int(b) in buckets]
        return [p for level in table["levels"] for p in level]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        schema = StructType.fromJson(self.tables[name]["schema"])
        paths = [f"{self.folder}/{p}" for p in self.paths(name, buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class Commit:
    """Changes to the tables of a store, seen by nobody until ``publish``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.before = Store(spark, folder)
        self.after = Store(spark, folder, self.before.number)
        self.spark, self.folder = spark, self.before.folder

    def _write(self, name: str, df: DataFrame, by: str | None = None) -> str:
        """Write ``df`` to a new folder of a table; its path below the store."""
        path = f"{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.folder}/{path}")
        return path

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The whole table anew; returns it as written."""
        self.after.tables[name] = {"schema": df.schema.jsonValue(), "levels": [[self._write(name, df)]]}
        return self.after.read(name)

    def append(self, name: str, df: DataFrame) -> None:
        """Further rows of an appended table."""
        table = self.after.tables.get(name, {"schema": df.schema.jsonValue(), "levels": []})
        levels = [[*level] for level in table["levels"]] or [[]]
        levels[0].append(self._write(name, df))
        self.after.tables[name] = {"schema": table["schema"], "levels": levels}
        for i in range(len(levels)):
            if len(levels[i]) >= TIER:
                schema = StructType.fromJson(table["schema"])
                rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in levels[i]))
                merged = self._write(name, rows.coalesce(max(1, rows.rdd.getNumPartitions() // TIER)))
                levels[i] = []
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(merged)

    def create(self, name: str, df: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """A keyed table in hash buckets."""
        self.after.tables[name] = {"schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "folders": {}}
        self._put(name, df, list(range(buckets)))

    def change(self, name: str, keys: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A keyed table with the rows of the buckets that hold ``keys`` (its key column) put through ``made``.

        ``made`` gets all rows of those buckets and gives all that they hold afterwards; no other bucket is read or
        written. Returns the table.
        """
        table = self.after.tables[name]
        column = keys.select(F.col(keys.columns[0]).cast(StructType.fromJson(table["schema"])[table["key"]].dataType).alias("key"))
        touched = sorted(r[0] for r in column.where("key IS NOT NULL").select(_bucket("key", table["buckets"])).distinct().collect())
        if touched:
            self._put(name, made(self.after.read(name, touched)), touched)
        return self.after.read(name)

    def _put(self, name: str, df: DataFrame, touched: list[int]) -> None:
        table = self.after.tables[name]
        placed = df.withColumn("_bucket", _bucket(table["key"], table["buckets"])).hint("rebalance", F.col("_bucket"))
        path = self._write(name, placed, "_bucket")
        found = {n.partition("=")[2] for n, _ in _names(self.spark, f"{self.folder}/{path}") if n.startswith("_bucket=")}
        if not found <= {str(b) for b in touched}:
            raise ValueError(f"{name}: rows outside of the buckets of the keys given")
        kept = {b: p for b, p in table["folders"].items() if int(b) not in touched}
        self.after.tables[name] = {**table, "folders": kept | {b: f"{path}/_bucket={b}" for b in found}}

    def publish(self) -> Store:
        """Make the changes the store's state, all at once."""
        number = self.before.number + 1
        fs, final, conf = _file_system(self.spark, self.before.place(number))
        jvm = self.spark._jvm
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{_COMMITS}/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(self.after.tables).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        return Store(self.spark, self.folder, number)


def vacuum(spark: SparkSession, folder: str, keep: int = 10, older_than_ms: int = 86_400_000) -> list[str]:
    """Delete what none of the last ``keep`` commits names and nobody has written for ``older_than_ms``; returns the paths."""
    store = Store(spark, folder)
    numbers = sorted(int(n.removesuffix(".json")) for n, _ in _names(spark, f"{store.folder}/{_COMMITS}") if n[:1].isdigit())
    live = set()
    for number in numbers[-keep:]:
        at = Store(spark, folder, number)
        live |= {"/".join(p.split("/")[:2]) for name in at.tables for p in at.paths(name)}
    gone = [f"{_COMMITS}/{n:010d}.json" for n in numbers[:-keep]]
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for name in store.tables:
        gone += [f"{name}/{n}" for n, changed in _names(spark, f"{store.folder}/{name}") if f"{name}/{n}" not in live and now - changed > older_than_ms]
    for path in gone:
        fs, place, _ = _file_system(spark, f"{store.folder}/{path}")
        fs.delete(place, True)
    return gone
