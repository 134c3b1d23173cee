"""Settlement of sold order lines against listed stock, idempotent and in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from partflow.operators.folds import HOT_ROWS, block_starts
from partflow.sources.scratch import stored

OVERLAP_MINUTES = 5


def _window_start(watermark: DataFrame) -> Column:
    """Five minutes before the watermark (one row, last_polled_at); without one the query fails."""
    polled = watermark.select("last_polled_at").scalar()
    missing = F.raise_error(F.lit("Poll watermark is not initialised")).cast(watermark.schema["last_polled_at"].dataType)
    return F.coalesce(polled, missing) - F.expr(f"INTERVAL {OVERLAP_MINUTES} MINUTES")


def poll_window(lines: DataFrame, watermark: DataFrame, now: Column) -> DataFrame:
    """Lines created from five minutes before the watermark (one row, last_polled_at) until ``now``."""
    return lines.where((F.col("created") >= _window_start(watermark)) & (F.col("created") <= now))


def late_lines(lines: DataFrame, watermark: DataFrame) -> DataFrame:
    """Lines older than the window: they are never fetched."""
    return lines.where(F.col("created") < _window_start(watermark))


def unprocessed(lines: DataFrame, processed: DataFrame) -> DataFrame:
    """Lines whose (order, line) has not been settled or quarantined before."""
    return lines.join(processed.select("order_id", "line_id"), ["order_id", "line_id"], "left_anti")


ORDER = ("created", "order_id", "line_id", "listing_id", "quantity")


def settle(parts: DataFrame, lines: DataFrame, processed: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A verdict for every line: status processed, quarantined or skipped, its part, reason and what is left.

    Lines come in the order of ``ORDER``. A line seen before (or earlier in this batch) is skipped; one
    without a listing, or that would take more than is listed or in stock, is quarantined and takes
    nothing. When the listed stock reaches 0 the listing ends, so later lines of it find none. Lines of a
    listing that no part has are settled one by one; those of a real listing stand together in order, and a
    task carries one running stock through them; of a listing with very many lines each block of them is
    carried from its own start (``folds``). Lines are written once with their mark, since their counts and each
    kind of verdict would compute them anew.
    """
    turn = F.row_number().over(Window.partitionBy("order_id", "line_id").orderBy(*ORDER))
    old = processed.select("order_id", "line_id").distinct().withColumn("_old", F.lit(True))
    columns = ["order_id", "line_id", "listing_id", "quantity", "created"]
    skip = F.col("_skip")
    marks = lines.withColumn("_turn", turn).join(old, ["order_id", "line_id"], "left")
    marked = stored(marks.select(*columns, (F.col("_old").isNotNull() | (F.col("_turn") > 1)).alias("_skip")), "lines")
    nothing = [F.lit(None).cast("long").alias("part_id"), F.lit(0).alias("quantity_depleted")]
    skipped = marked.where(skip).select(*columns, F.lit("skipped").alias("status"), *nothing, F.lit(None).cast("string").alias("quarantine_reason"))
    listed = parts.where("ebay_listing_id IS NOT NULL").select(F.col("ebay_listing_id").alias("listing_id"), F.col("id").alias("_part"), F.col("quantity").alias("_stock"), F.col("listed_quantity").alias("_listed"))
    found = marked.where(~skip).select(*columns).join(listed, "listing_id", "left")
    lost_text = F.concat(F.lit("No matching listing for eBay item "), F.coalesce("listing_id", F.lit("null")))
    lost = found.where("_part IS NULL").select(*columns, F.lit("quarantined").alias("status"), *nothing, lost_text.alias("quarantine_reason"))

    live = found.where("_part IS NOT NULL").select(*columns, "_part", F.col("_stock").cast("int").alias("_stock"), F.col("_listed").cast("int").alias("_listed"))
    started = block_starts(live.withColumn("_room", F.least("_stock", "_listed")), "listing_id", ORDER, "quantity", "_room", hot_rows)
    dealt = started.select(*live.columns, "_block", F.col("_used").cast("int").alias("_used")).repartition("listing_id", "_block").sortWithinPartitions("listing_id", "_block", *ORDER)
    rows = dealt.mapInArrow(_fold, T.StructType([*dealt.schema.fields, T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())]))
    gone = F.col("reason").startswith("No matching")
    done = rows.select(
        *columns, "status", F.when(F.coalesce(gone, F.lit(False)), None).otherwise(F.col("_part")).alias("part_id"),
        F.when(F.col("status") == "processed", F.col("quantity")).otherwise(0).alias("quantity_depleted"), F.col("reason").alias("quarantine_reason"),
    )
    return skipped.unionByName(lost).unionByName(done)


Running = tuple[int, int, bool]


def judge(listing: str | None, n: int | None, running: Running) -> tuple[str, str | None, Running]:
    """Status and reason of one line, and what it leaves of (stock, listed stock, whether the listing is open)."""
    stock, listed, is_open = running
    if is_open and n is not None and stock >= n and listed >= n:
        return "processed", None, (stock - n, listed - n, listed != n)
    reason = f"Invariant violation: quantity={stock}, listedQuantity={listed}, sold={n}" if is_open else f"No matching listing for eBay item {'null' if listing is None else listing}"
    return "quarantined", reason, running


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Status and reason of lines that come sorted by listing and order."""
    block, running = None, (0, 0, True)
    for batch in batches:
        statuses, reasons = [], []
        for key, n, stock, listed, part, used in zip(*(batch.column(c).to_pylist() for c in ("listing_id", "quantity", "_stock", "_listed", "_block", "_used"))):
            if (key, part) != block:
                block, running = (key, part), (stock - used, listed - used, not used or listed != used)
            status, reason, running = judge(key, n, running)
            statuses.append(status)
            reasons.append(reason)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(statuses, pa.string()), pa.array(reasons, pa.string())], [*batch.schema.names, "status", "reason"])


def settled_parts(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Parts after the verdicts: stock and listed stock reduced, ended listings cleared."""
    sold = verdicts.where("status = 'processed'").groupBy("part_id").agg(F.sum("quantity_depleted").cast("int").alias("_sold"))
    joined = parts.join(sold, parts["id"] == sold["part_id"], "left").withColumn("_n", F.coalesce("_sold", F.lit(0)))
    ended = (F.col("_n") > 0) & (F.col("listed_quantity") == F.col("_n"))
    columns = {"quantity": F.col("quantity") - F.col("_n"), "listed_quantity": F.col("listed_quantity") - F.col("_n"), "ebay_listing_id": F.when(~ended, F.col("ebay_listing_id"))}
    return joined.select(*(columns.get(c, F.col(c)).alias(c) for c in parts.columns))


def settlement_events(verdicts: DataFrame) -> DataFrame:
    """Ledger rows of processed lines."""
    return verdicts.where("status = 'processed'").select("part_id", F.lit("ebay_sold").alias("event_type"), (-F.col("quantity_depleted")).alias("quantity_change"), F.concat(F.lit("eBay order #"), "order_id").alias("note"))


def newly_processed(verdicts: DataFrame) -> DataFrame:
    """The lines that the verdicts add to the processed ones."""
    return verdicts.where("status != 'skipped'").select("order_id", "line_id", "part_id", "quantity_depleted", "quarantine_reason")


def processed_after(processed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The processed lines with the new ones."""
    new = newly_processed(verdicts)
    return processed.select(*new.columns).unionByName(new)


def settlement_summary(verdicts: DataFrame) -> DataFrame:
    """One row: how many lines were processed, quarantined and skipped."""
    return verdicts.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "quarantined", "skipped")))


class Poll(NamedTuple):
    """What one poll leaves: verdicts, the tables after them, a summary row and the new watermark."""

    verdicts: DataFrame
    parts: DataFrame
    events: DataFrame
    processed: DataFrame
    summary: DataFrame
    watermark: DataFrame


def poll_orders(parts: DataFrame, lines: DataFrame, processed: DataFrame, watermark: DataFrame, now: Column) -> Poll:
    """Settle the lines of the poll window. Nothing is written: ``streaming.settlement.run_poll`` stores the outcome."""
    return after_poll(parts, processed, settle(parts, poll_window(lines, watermark, now), processed), now)


def after_poll(parts: DataFrame, processed: DataFrame, verdicts: DataFrame, now: Column) -> Poll:
    """The outcome of a poll from its verdicts."""
    mark = parts.sparkSession.range(1).select(now.alias("last_polled_at"))
    return Poll(verdicts, settled_parts(parts, verdicts), settlement_events(verdicts), processed_after(processed, verdicts), settlement_summary(verdicts), mark)
