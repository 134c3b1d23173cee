"""Settlement as a stream, with what has been seen and what is in stock as keyed state; and the stored poll.

Two stateful operators follow each other: one by order knows its lines that came before, until ``keep_days`` after its
last new one, and marks repeats; one by listing holds the running stock, which it starts from the parts given. Orders and listings lie in
hash buckets, whose number a checkpoint keeps, as entries of map state; a batch reads and writes the entries of its own
keys only, so its work does not grow with history. Verdicts go to a file sink, which takes each batch once; a query that
is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from partflow.operators.settlement import ORDER, Poll, judge, newly_processed, poll_window, settle, settled_parts, settlement_events, settlement_summary
from partflow.sources.commits import BUCKETS, Commit, Store

VERDICTS = "order_id string, line_id string, listing_id string, quantity int, created timestamp_ntz, status string, part_id long, quantity_depleted int, quarantine_reason string"


def dedupe_stream(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Order lines (event time ``created``) without repeats of (order, line) that come within the watermark."""
    return lines.withWatermark("created", delay).dropDuplicatesWithinWatermark(["order_id", "line_id"])


class _Seen(StatefulProcessor):
    """Marks every row of an (order, line) but the first one ever, in the order of arrival; an order's lines are one entry of its bucket's state."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "order string", "lines array<string>", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(list(ORDER), kind="stable")
        known: dict[str, tuple[list, set]] = {}
        changed, skip, old = set(), [], self.seen.exists()
        for order, line in zip(frame["key"], frame["line_id"]):
            if order not in known:
                held = self.seen.getValue((order,)) if old else None
                lines = list(held[0]) if held else []
                known[order] = lines, set(lines)
            lines, met = known[order]
            skip.append(line in met)
            if line not in met:
                lines.append(line)
                met.add(line)
                changed.add(order)
        for order in changed:
            self.seen.updateValue((order,), (known[order][0],))
        frame["skip"] = skip
        yield frame.drop(columns="bucket")

    def close(self) -> None:
        pass


class _Stock(StatefulProcessor):
    """Verdicts on the rows of a bucket of listings, with each listing's part and running stock as an entry of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getMapState("stock", "listing string", "part_id long, stock int, listed int, is_open boolean")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for listing, part, stock, listed in zip(*(initialState[c] for c in ("key", "part_id", "stock", "listed"))):
            self.stock.updateValue((listing,), (int(part), int(stock), int(listed), True))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(list(ORDER), kind="stable")
        parts: dict[str, int | None] = {}
        left: dict[str, Running] = {}
        changed, out = set(), []
        plain = lambda c: frame[c].astype(object).where(frame[c].notna(), None)
        for name, listing, n, skip in zip(frame["key"], plain("listing_id"), plain("quantity"), frame["skip"]):
            if skip:
                out.append(("skipped", None, 0, None))
                continue
            if name not in parts:
                state = self.stock.getValue((name,))
                parts[name], left[name] = (state[0], tuple(state[1:])) if state else (None, (0, 0, False))
            before = left[name]
            status, reason, left[name] = judge(listing, None if n is None else int(n), before)
            if left[name] != before:
                changed.add(name)
            found = parts[name] if status == "processed" or reason.startswith("Invariant") else None
            out.append((status, found, int(n) if status == "processed" else 0, reason))
        for name in changed:
            self.stock.updateValue((name,), (parts[name], *left[name]))
        made = pd.DataFrame(out, columns=["status", "part_id", "quantity_depleted", "quarantine_reason"], index=frame.index)
        made["part_id"] = made["part_id"].astype("Int64")
        yield pd.concat([frame[["order_id", "line_id", "listing_id", "quantity", "created"]], made], axis=1)

    def close(self) -> None:
        pass


#: State is kept by order and by listing, but a task calls Python once for a bucket of them: a call costs far more than a row.
STATE_BUCKETS = 1024


def _state_bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(STATE_BUCKETS)).cast("int").alias("bucket")


def settle_stream(lines: DataFrame, parts: DataFrame, path: str, checkpoint: str, keep_days: int = 400) -> StreamingQuery:
    """Settle a stream of order lines against the stock of ``parts``, which a new checkpoint starts from; verdicts go below ``path``.

    The rows are those of ``settle`` with batches in the place of polls.
    """
    columns = [c.split()[0] + " " + c.split()[1] for c in VERDICTS.split(", ")[:5]]
    names = [c.split()[0] for c in columns]
    given = lines.select(*(F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, columns)))
    keyed = given.withColumn("key", F.coalesce(F.concat(F.lit("="), "order_id"), F.lit(""))).select("*", _state_bucket())
    marked = keyed.groupBy("bucket").transformWithStateInPandas(_Seen(keep_days * 86_400_000), ", ".join([*columns, "key string", "skip boolean"]), "Append", "ProcessingTime")
    by_listing = marked.withColumn("key", F.coalesce(F.concat(F.lit("="), "listing_id"), F.lit(""))).select("*", _state_bucket())
    listed = parts.where("ebay_listing_id IS NOT NULL").select(
        F.concat(F.lit("="), "ebay_listing_id").alias("key"), F.col("id").alias("part_id"), F.col("quantity").cast("int").alias("stock"), F.col("listed_quantity").cast("int").alias("listed")
    ).select("*", _state_bucket())
    verdicts = by_listing.groupBy("bucket").transformWithStateInPandas(_Stock(), VERDICTS, "Append", "ProcessingTime", initialState=listed.groupBy("bucket"))
    with _state_settings(lines.sparkSession):
        return verdicts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: State in RocksDB, of which checkpoints hold the changes; no batches without data, which state that expires would ask for without end.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """A query takes its settings from the session when it starts; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def open_store(parts: DataFrame, watermark: DataFrame, folder: str, processed: DataFrame | None = None, buckets: int = BUCKETS) -> Store:
    """A new store for polls: parts by id, the lines processed before, an empty ledger and the watermark, in one commit."""
    spark, commit = parts.sparkSession, Commit(parts.sparkSession, folder)
    if commit.before.number:
        raise ValueError(f"{folder} holds a store")
    empty = spark.createDataFrame([], VERDICTS)
    commit.create("parts", parts, "id", buckets)
    commit.append("processed", newly_processed(empty) if processed is None else processed.select(*newly_processed(empty).columns))
    commit.append("events", settlement_events(empty))
    commit.replace("verdicts", empty)
    commit.replace("watermark", watermark)
    return commit.publish()


def run_poll(spark: SparkSession, folder: str, lines: DataFrame, now: Column) -> Poll:
    """One poll over the store below ``folder``: verdicts, stock, processed lines, ledger and watermark change in one commit.

    Verdicts are written first, so that everything else follows from the same rows; of the stock only the buckets
    with sold parts are read and written, and processed lines and ledger rows are added. Nothing of it counts before the
    commit. A poll that fails anywhere before leaves the old state, watermark included, and its repeat settles the same
    window from the old stock; one that fails after it has taken place, and its lines are skipped by the next.
    """
    commit = Commit(spark, folder)
    parts, processed, mark = (commit.before.read(name) for name in ("parts", "processed", "watermark"))
    verdicts = commit.replace("verdicts", settle(parts, poll_window(lines, mark, now), processed))
    after = commit.change("parts", verdicts.where("status = 'processed'").select("part_id"), lambda rows: settled_parts(rows, verdicts))
    commit.append("processed", newly_processed(verdicts))
    commit.append("events", settlement_events(verdicts))
    polled = commit.replace("watermark", spark.range(1).select(now.alias("last_polled_at")))
    store = commit.publish()
    return Poll(verdicts, after, settlement_events(verdicts), store.read("processed"), settlement_summary(verdicts), polled)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """All verdicts so far."""
    return spark.read.schema(VERDICTS).parquet(path)
