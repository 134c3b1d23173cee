"""Settlement with keyed state: batches, restarts and replays against the batch operator."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partflow.operators import settlement
from partflow.sources import tables
from partflow.streaming.settlement import VERDICTS, _Seen, _Stock, read_verdicts, settle_stream

LINES = "order_id string, line_id string, listing_id string, quantity int, created timestamp_ntz"
PARTS = "id long, part_number string, quantity int, listed_quantity int, ebay_listing_id string"
PROCESSED = "order_id string, line_id string, part_id long, quantity_depleted int, quarantine_reason string"
FIELDS = [f.split()[0] for f in VERDICTS.split(", ")]


@pytest.fixture
def parts(spark):
    return spark.createDataFrame([(1, "P1", 10, 6, "L1"), (2, "P2", 90, 70, "L2"), (3, "P3", 5, 0, None)], PARTS)


def lines(spark, rows):
    return spark.createDataFrame([(o, n, listing, q, datetime(2024, 1, 1) + timedelta(minutes=m)) for o, n, listing, q, m in rows], LINES)


def test_state_goes_on_over_batches_and_restarts(spark, parts, tmp_path):
    """Each batch is what a poll gives after those before it; a file given before is not read again."""
    batches = [
        [("1", "1", "L1", 2, 0), ("1", "2", "L9", 1, 1), ("2", "1", "L2", 5, 2), ("1", "1", "L2", 3, 3), (None, "1", "L2", 1, 4), ("3", None, "L1", 9, 5)],
        [("1", "1", "L1", 2, 9), ("4", "1", "L1", 4, 8), ("1", "2", "L9", 1, 7), ("5", "1", None, 1, 10), ("6", "1", "L2", None, 11)],
        [("7", "1", "L1", 1, 20), ("2", "1", "L2", 5, 21), *((str(100 + i), "1", "L2", 1 + i % 3, 30 + i) for i in range(60))],
    ]
    source, out, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    stock, processed, want = parts, spark.createDataFrame([], PROCESSED), []
    for rows in batches:
        batch = lines(spark, rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        settle_stream(spark.readStream.schema(LINES).parquet(source), parts, out, checkpoint).awaitTermination()
        verdicts = settlement.settle(stock, batch, processed.where("order_id IS NOT NULL AND line_id IS NOT NULL"))
        want += [tuple(r[f] for f in FIELDS) for r in verdicts.collect()]
        held = spark.createDataFrame(verdicts.collect(), verdicts.schema)
        stock = spark.createDataFrame(settlement.settled_parts(stock, held).collect(), PARTS)
        processed = spark.createDataFrame([*processed.collect(), *settlement.newly_processed(held).collect()], PROCESSED)
    found = [tuple(r[f] for f in FIELDS) for r in read_verdicts(spark, out).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_replayed_stream_gives_the_same_rows(spark, parts, tmp_path):
    source = f"file://{tmp_path}/in"
    lines(spark, [(str(i % 40), "1", "L2", 1 + i % 4, i) for i in range(120)]).repartition(3).write.parquet(source)
    found = []
    for n in (1, 2):
        stream = spark.readStream.schema(LINES).parquet(source)
        settle_stream(stream, parts, f"file://{tmp_path}/out{n}", f"file://{tmp_path}/check{n}").awaitTermination()
        found.append(sorted(map(str, read_verdicts(spark, f"file://{tmp_path}/out{n}").collect())))
    assert found[0] == found[1] and len(found[0]) == 120
    assert read_verdicts(spark, f"file://{tmp_path}/out1").where(F.col("status") == "skipped").count() == 80


def test_orders_as_json_lines(spark, tmp_path):
    """Batch and stream give the same rows; broken lines and orders without lines are reported."""
    rows = ['{"orderId":"1","creationDate":"2024-01-01T10:00:00Z","lineItems":[{"lineItemId":"a","legacyItemId":"L1","quantity":2},{"lineItemId":"b","legacyItemId":null,"quantity":1}]}', '{"orderId":"2","lineItems":[]}', '{"orderId":"3"}', '{"orderId":"4","lineItems":[{"lineIt', "no json", '{"orderId":"5","lineItems":[{"lineItemId":"a","quantity":"many"}]}', ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(rows[:3]))
    (tmp_path / "in/b.json").write_text("\n".join(rows[3:]))
    batch = tables.split_orders(tables.read_orders(spark, f"file://{tmp_path}/in"))
    stream = tables.split_orders(tables.read_orders(spark, f"file://{tmp_path}/in", stream=True))
    out = f"file://{tmp_path}/out"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    found = sorted(map(str, batch.collect()))
    assert found == sorted(map(str, spark.read.schema(stream.schema).parquet(out).collect()))
    got = sorted((r.kind, r.order_id or "", r.line_id or "", r.pos if r.pos is not None else -1, r.quantity or 0) for r in batch.collect())
    assert got == [("corrupt", "", "", -1, 0)] * 3 + [("line", "1", "a", 0, 2), ("line", "1", "b", 1, 1), ("no_lines", "2", "", -1, 0), ("no_lines", "3", "", -1, 0)]
    assert {r.corrupt for r in batch.where("kind = 'corrupt'").collect()} == {rows[3], rows[4], rows[5]}


class _Map(dict):
    """Map state of one bucket."""

    def exists(self):
        return bool(self)

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def getMapState(self, *args):
        return self


def test_one_call_serves_a_bucket_of_orders_and_listings():
    """A call to Python costs far more than a row, so keys come in buckets; state stays an entry for each key."""
    seen, stock = _Seen(1000), _Stock()
    orders, listings = _Map(), _Map()
    seen.init(orders), stock.init(listings)
    rows = [(f"{i % 50}", "1", f"L{i % 7}", 1, pd.Timestamp(2024, 1, 1, 0, i), f"={i % 50}", 3) for i in range(60)]
    given = pd.DataFrame(rows, columns=["order_id", "line_id", "listing_id", "quantity", "created", "key", "bucket"])
    for turn in (1, 2):
        (marked,) = seen.handleInputRows((3,), iter([given.head(40), given.tail(20)]), None)
        assert len(orders) == 50 and marked["skip"].sum() == (10 if turn == 1 else 60)
        marked["key"] = "=" + marked["listing_id"]
        if turn == 1:
            stock.handleInitialState((3,), pd.DataFrame({"key": ["=L0", "=L1"], "part_id": [10, 11], "stock": [5, 100], "listed": [5, 100]}), None)
            (made,) = stock.handleInputRows((3,), iter([marked]), None)
            assert made["status"].value_counts().to_dict() == {"processed": 12, "quarantined": 38, "skipped": 10}
            assert listings == {("=L0",): (10, 0, 0, False), ("=L1",): (11, 93, 93, True)}
