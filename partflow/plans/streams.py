"""Streaming queries: the file source reads the given tables as a stream until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partflow.operators.settlement import poll_window
from partflow.plans.changes import _POLLED, _SETTLED, _seen, _sold, _watermark
from partflow.plans.registry import query
from partflow.sources import domain, tables
from partflow.sources.commits import Store
from partflow.sources.domain import with_views
from partflow.sources.scratch import shared_dir, stored
from partflow.streaming.settlement import VERDICTS, dedupe_stream, open_store, read_verdicts, run_poll, settle_stream


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of lineitem as a stream, with their order's date from the static side."""
    schema = domain.table(spark, path, "lineitem").schema
    lines = spark.readStream.schema(schema).parquet(f"{path}/lineite[m].parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = domain.table(spark, path, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("string").alias("line_id"), F.concat(F.lit("L"), "l_partkey").alias("listing_id"),
        (F.col("l_quantity") % 3 + 1).cast("int").alias("quantity"), F.col("o_orderdate").alias("created"),
    )


@query(f"{with_views('order_lines')} SELECT DISTINCT order_id, line_id FROM order_lines")
def str2_dedupe_stream(spark: SparkSession, path: str) -> DataFrame:
    lines = _stream(spark, path).withColumn("created", F.col("created").cast("timestamp"))
    out = shared_dir(spark, "deduped")
    rows = dedupe_stream(lines).select("order_id", "line_id")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("order_id string, line_id string").parquet(out)


@query(_SETTLED.replace("CAST(order_id AS BIGINT) % 50 = 0 AS old", "false AS old") + " SELECT order_id, line_id, listing_id, quantity, status, part_id, quantity_depleted, quarantine_reason FROM settled")
def str3_settle_stream(spark: SparkSession, path: str) -> DataFrame:
    out = shared_dir(spark, "settled")
    settle_stream(_stream(spark, path), domain.parts(spark, path), out, shared_dir(spark, "stream")).awaitTermination()
    return read_verdicts(spark, out).select(*(f.split()[0] for f in VERDICTS.split(", ") if not f.startswith("created")))


def _polled(spark: SparkSession, path: str) -> Store:
    """The store after a poll and its repeat, which changes nothing.

    Lines are fetched once for both: the repeat's window, from the new watermark on, lies in that of the poll.
    """
    mark, folder = _watermark(spark, path), shared_dir(spark, "poll")
    now = mark.select(F.col("last_polled_at") + F.expr("INTERVAL 300 DAYS")).scalar()
    open_store(domain.parts(spark, path), mark, folder, _seen(spark, path))
    fetched = stored(poll_window(_sold(spark, path), mark, now), "fetched")
    for _ in range(2):
        run_poll(spark, folder, fetched, now)
    return Store(spark, folder)


@query(f"{_POLLED} SELECT part_id, 'ebay_sold' AS event_type, -quantity_depleted AS quantity_change, 'eBay order #' || order_id AS note FROM settled WHERE status = 'processed'")
def snk1_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _polled(spark, path).read("events")


@query(f"""{_POLLED}, sold AS (SELECT part_id, sum(quantity_depleted) AS n FROM settled WHERE status = 'processed' GROUP BY part_id)
SELECT id, CAST(quantity - coalesce(n, 0) AS INTEGER) AS quantity, CAST(listed_quantity - coalesce(n, 0) AS INTEGER) AS listed_quantity, CASE WHEN n IS NULL OR listed_quantity <> n THEN ebay_listing_id END AS ebay_listing_id FROM parts LEFT JOIN sold ON part_id = id""")
def snk2_stored_parts(spark: SparkSession, path: str) -> DataFrame:
    return _polled(spark, path).read("parts").select("id", "quantity", "listed_quantity", "ebay_listing_id")


_ORDERS = """lines_of AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 9 <> 3)
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_id, 'L' || l_partkey AS listing_id, CAST(l_quantity AS INTEGER) AS quantity, 'line' AS kind FROM orders JOIN lines_of ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 5
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL, 'no_lines' FROM orders WHERE o_orderkey % 11 <> 5 AND o_orderkey NOT IN (SELECT l_orderkey FROM lines_of)
UNION ALL SELECT NULL, NULL, NULL, NULL, 'corrupt' FROM orders WHERE o_orderkey % 11 = 5"""


@query(f"WITH {_ORDERS}")
def src2_order_stream(spark: SparkSession, path: str) -> DataFrame:
    """Orders as files of JSON lines, some of them broken off and some orders without lines, read as a stream."""
    line = F.struct(F.col("l_linenumber").cast("string").alias("lineItemId"), F.concat(F.lit("L"), "l_partkey").alias("legacyItemId"), F.col("l_quantity").cast("int").alias("quantity"))
    lists = domain.table(spark, path, "lineitem").where("l_orderkey % 9 <> 3").groupBy("l_orderkey").agg(F.collect_list(line).alias("lineItems"))
    orders = domain.table(spark, path, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("orderId"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationDate"), "lineItems"))
    source, out = shared_dir(spark, "orders"), shared_dir(spark, "lines")
    orders.select(F.when(F.col("o_orderkey") % 11 == 5, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("value")).write.text(source)
    rows = tables.split_orders(tables.read_orders(spark, source, stream=True)).select("order_id", "line_id", "listing_id", "quantity", "kind")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
