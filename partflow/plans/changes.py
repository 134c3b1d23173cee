"""Queries of stock changes and of settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partflow.operators import catalog, inventory, settlement
from partflow.plans.registry import query
from partflow.sources import domain, tables
from partflow.sources.domain import with_views

_STATE = ("id", "part_number", "part_number_raw", "brand", "description", "quantity", "listed_quantity", "ebay_listing_id")


def _some_parts(spark: SparkSession, path: str) -> DataFrame:
    return domain.parts(spark, path).where("id % 4 <> 3").select(*_STATE)


def _adds(spark: SparkSession, path: str) -> DataFrame:
    """Intake requests from order lines: seq is unique for each distinct (order, line, part)."""
    lines = domain.table(spark, path, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("l_quantity").cast("int").alias("quantity"))
    seq = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    brand = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("B"), F.col("l_orderkey") % 10))
    return lines.select(seq.alias("seq"), F.concat(F.lit(" #"), domain.raw_number("l_partkey")).alias("part_number"), brand.alias("brand"), F.lit(None).cast("string").alias("description"), "quantity", F.concat(F.lit("line "), "l_linenumber").alias("note"))


_ADDS = """adds AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq, ' #wp-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS raw, 'WP' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS number,
  CASE WHEN l_orderkey % 3 = 0 THEN 'B' || l_orderkey % 10 END AS brand, CAST(sum(l_quantity) AS INTEGER) AS quantity, 'line ' || l_linenumber AS note FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
held AS (SELECT id, part_number, part_number_raw, brand, description, quantity, listed_quantity, ebay_listing_id FROM parts WHERE id % 4 <> 3),
rolled AS (SELECT number, CAST(sum(quantity) AS INTEGER) AS more, max_by(brand, seq) FILTER (WHERE brand IS NOT NULL) AS brand, regexp_replace(trim(min_by(raw, seq)), '^#+', '') AS raw, min(seq) AS first FROM adds GROUP BY number),
fresh AS (SELECT number, (SELECT max(id) FROM held) + row_number() OVER (ORDER BY first, number) AS id FROM rolled WHERE number NOT IN (SELECT part_number FROM held)),
state AS (SELECT coalesce(s.id, f.id) AS id, coalesce(s.part_number, r.number) AS part_number, coalesce(s.part_number_raw, r.raw) AS part_number_raw, coalesce(r.brand, s.brand) AS brand, s.description,
  CAST(coalesce(s.quantity, 0) + coalesce(r.more, 0) AS INTEGER) AS quantity, coalesce(s.listed_quantity, 0) AS listed_quantity, s.ebay_listing_id FROM held s FULL JOIN rolled r ON r.number = s.part_number LEFT JOIN fresh f ON f.number = r.number)"""


@query(f"{with_views('parts')}, {_ADDS} SELECT * FROM state")
def mut1_add_parts(spark: SparkSession, path: str) -> DataFrame:
    return inventory.add_parts(_some_parts(spark, path), _adds(spark, path))[0]


@query(f"{with_views('parts')}, {_ADDS} SELECT seq, s.id AS part_id, 'added' AS event_type, a.quantity AS quantity_change, note FROM adds a JOIN state s ON s.part_number = a.number")
def mut1_add_part_events(spark: SparkSession, path: str) -> DataFrame:
    return inventory.add_parts(_some_parts(spark, path), _adds(spark, path))[1]


def _takes(spark: SparkSession, path: str) -> DataFrame:
    lines = domain.table(spark, path, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q"))
    seq = F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    return lines.select(seq.alias("seq"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 50 == 0, 10_000_000).otherwise(0)).alias("part_id"), (F.col("q") % 4 + 1).cast("int").alias("quantity"), F.when(F.col("l_orderkey") % 2 == 0, "used").otherwise("sold").alias("reason"), F.lit(None).cast("string").alias("note"))


_TAKES = """takes AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq, l_partkey + CASE WHEN l_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS part_id,
  CAST(max(l_quantity) % 4 + 1 AS INTEGER) AS quantity, CASE WHEN l_orderkey % 2 = 0 THEN 'used' ELSE 'sold' END AS reason FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
turns AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY seq) AS turn FROM takes),
fold AS (SELECT id AS part_id, listed_quantity AS listed, CAST(0 AS BIGINT) AS turn, CAST(quantity AS INTEGER) AS left_over, CAST(NULL AS BIGINT) AS seq, 0 AS take, '' AS reason, false AS ok, 0 AS free FROM parts
  UNION ALL SELECT f.part_id, f.listed, t.turn, CASE WHEN t.quantity <= f.left_over - f.listed THEN f.left_over - t.quantity ELSE f.left_over END, t.seq, t.quantity, t.reason, t.quantity <= f.left_over - f.listed, CAST(f.left_over - f.listed AS INTEGER)
  FROM fold f JOIN turns t ON t.part_id = f.part_id AND t.turn = f.turn + 1)"""


def _recursive(with_clause: str) -> str:
    return with_clause.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_recursive(with_views('parts'))}, {_TAKES} SELECT part_id AS id, arg_max(left_over, turn) AS quantity FROM fold GROUP BY part_id")
def mut2_deplete_parts(spark: SparkSession, path: str) -> DataFrame:
    return inventory.deplete_parts(domain.parts(spark, path), _takes(spark, path))[0].select("id", "quantity")


@query(f"{_recursive(with_views('parts'))}, {_TAKES} SELECT seq, part_id, reason AS event_type, -take AS quantity_change FROM fold WHERE ok")
def mut2_deplete_events(spark: SparkSession, path: str) -> DataFrame:
    return inventory.deplete_parts(domain.parts(spark, path), _takes(spark, path))[1].drop("note")


@query(f"""{_recursive(with_views('parts'))}, {_TAKES} SELECT seq, part_id, take AS quantity, 'Cannot deplete ' || take || ' — only ' || free || ' available (' || listed || ' listed on eBay)' AS message FROM fold WHERE turn > 0 AND NOT ok
UNION ALL SELECT seq, part_id, quantity, 'Part not found' FROM takes WHERE part_id NOT IN (SELECT id FROM parts)""")
def mut2_deplete_rejects(spark: SparkSession, path: str) -> DataFrame:
    return inventory.deplete_parts(domain.parts(spark, path), _takes(spark, path))[2]


@query(f"""{with_views('parts')}, x AS (SELECT id, quantity, CAST(id % 12 AS INTEGER) - 1 AS listed, CASE WHEN id % 3 > 0 THEN 'L' || id END AS listing FROM parts)
SELECT id, CASE WHEN listed < 0 OR listed > quantity THEN 'listed_quantity must be between 0 and ' || quantity WHEN listed > 0 AND listing IS NULL THEN 'ebay_listing_id required when listed_quantity > 0'
WHEN listed = 0 AND listing IS NOT NULL THEN 'ebay_listing_id must be null when listed_quantity is 0' END AS message FROM x""")
def p16_check_listing(spark: SparkSession, path: str) -> DataFrame:
    parts = domain.parts(spark, path).select("id", "quantity", (F.col("id") % 12 - 1).cast("int").alias("listed_quantity"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("L"), "id")).alias("ebay_listing_id"))
    return inventory.check_listing(parts).select("id", "message")


def _patches(spark: SparkSession, path: str) -> DataFrame:
    """Two patches for each part: the first may break the listing rules, the second clears or sets other columns."""
    parts = domain.table(spark, path, "part").select(F.col("p_partkey").alias("part_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    p, k = F.col("part_id"), F.col("k")
    none = F.lit(None)
    return parts.select(
        (p * 2 + k).alias("seq"), "part_id", F.when(k == 1, F.concat(F.lit("B"), p % 7)).alias("brand"), none.cast("string").alias("description"),
        F.when((k == 0) & (p % 2 == 0), F.concat(F.lit("N"), p)).alias("ebay_listing_id"), (p % 5).cast("int").alias("listed_quantity"),
        (k == 1).alias("has_brand"), ((k == 1) & (p % 3 == 0)).alias("has_description"), (k == 0).alias("has_ebay_listing_id"), (k == 0).alias("has_listed_quantity"),
    )


@query(f"""{with_views('parts')}, x AS (SELECT *, CAST(id % 5 AS INTEGER) AS l, CASE WHEN id % 2 = 0 THEN 'N' || id END AS n FROM parts),
y AS (SELECT *, l <= quantity AND (l > 0) = (n IS NOT NULL) AS ok FROM x)
SELECT id, 'B' || id % 7 AS brand, CASE WHEN id % 3 = 0 THEN NULL ELSE description END AS description, CASE WHEN ok THEN n ELSE ebay_listing_id END AS ebay_listing_id, CASE WHEN ok THEN l ELSE listed_quantity END AS listed_quantity FROM y""")
def mut3_update_parts(spark: SparkSession, path: str) -> DataFrame:
    return inventory.update_parts(domain.parts(spark, path), _patches(spark, path))[0].select("id", "brand", "description", "ebay_listing_id", "listed_quantity")


_DELETED = "blocked AS (SELECT DISTINCT part_id FROM (SELECT l_partkey AS part_id FROM lineitem WHERE l_orderkey % 40 = 0) WHERE part_id % 3 = 0), gone AS (SELECT id FROM parts WHERE id % 3 = 0 AND id NOT IN (SELECT part_id FROM blocked))"


def _deletion(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    parts = domain.parts(spark, path)
    processed = domain.table(spark, path, "lineitem").where("l_orderkey % 40 = 0").select(F.col("l_partkey").alias("part_id"))
    return inventory.delete_parts(parts, domain.inventory_events(spark, path), domain.cross_references(spark, path), processed, parts.where("id % 3 = 0").select(F.col("id").alias("part_id")))


@query(f"""{with_views('parts', 'ev', 'xrefs')}, {_DELETED} SELECT 'part' AS kind, id, CAST(NULL AS VARCHAR) AS detail FROM parts WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'event', id, CAST(part_id AS VARCHAR) FROM ev WHERE part_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'reference', part_id, cross_ref_part_number FROM xrefs WHERE part_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'blocked', part_id, NULL FROM blocked""")
def mut4_delete_parts(spark: SparkSession, path: str) -> DataFrame:
    parts, events, refs, blocked = _deletion(spark, path)
    none = F.lit(None).cast("string").alias("detail")
    out = parts.select(F.lit("part").alias("kind"), "id", none)
    out = out.union(events.select(F.lit("event"), "id", F.col("part_id").cast("string"))).union(refs.select(F.lit("reference"), "part_id", "cross_ref_part_number"))
    return out.union(blocked.select(F.lit("blocked"), "part_id", none))


@query(f"""{with_views('parts', 'appliances')}
SELECT 'appliance' AS kind, id, CASE WHEN id % 2 = 0 THEN 'Patched' ELSE brand END || '/' || CASE WHEN id % 3 = 0 THEN 'stripped' ELSE status END AS detail FROM appliances WHERE id % 5 <> 0
UNION ALL SELECT 'part', id, CASE WHEN appliance_id % 5 <> 0 OR appliance_id NOT IN (SELECT id FROM appliances) THEN CAST(appliance_id AS VARCHAR) END FROM parts
UNION ALL SELECT 'appliance', (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 5 <> 0) + n_nationkey + 1, n_name || '/active' FROM nation""")
def mut5_appliance_changes(spark: SparkSession, path: str) -> DataFrame:
    appliances = domain.appliances(spark, path)
    patches = appliances.select(F.col("id").alias("seq"), "id", F.when(F.col("id") % 2 == 0, "Patched").alias("brand"), F.lit(None).cast("string").alias("model_number"), F.when(F.col("id") % 3 == 0, "stripped").alias("status"))
    patched = inventory.patch_appliances(appliances, patches)
    left, parts = inventory.delete_appliances(patched, domain.parts(spark, path), appliances.where("id % 5 = 0").select("id"))
    new = domain.table(spark, path, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("brand"), F.lit("X").alias("model_number"))
    made = inventory.create_appliances(left, new)
    detail = F.concat_ws("/", "brand", "status")
    return made.select(F.lit("appliance").alias("kind"), "id", detail.alias("detail")).union(parts.select(F.lit("part"), "id", F.col("appliance_id").cast("string")))


@query(f"""{with_views('parts', 'appliances')}, pulls AS (SELECT s_suppkey AS seq, s_suppkey AS appliance_id, 'WP' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 8, '0') AS number, CASE WHEN s_suppkey % 2 = 0 THEN 'by hand' END AS note FROM supplier)
SELECT p.id AS part_id, p.quantity + 2 AS quantity, u.appliance_id, coalesce(note, 'Pulled from ' || a.brand || ' ' || a.model_number || ' (appliance #' || a.id || ')') AS note
FROM pulls u JOIN parts p ON p.part_number = u.number JOIN appliances a ON a.id = u.appliance_id""")
def mut6_pull_parts(spark: SparkSession, path: str) -> DataFrame:
    parts = domain.parts(spark, path)
    number = F.concat(F.lit("wp-"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 8, "0"))
    asked = domain.table(spark, path, "supplier").select(
        F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("appliance_id"), number.alias("part_number"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("description"),
        F.lit(2).alias("quantity"), F.when(F.col("s_suppkey") % 2 == 0, "by hand").alias("note"),
    )
    known = asked.join(parts.select(F.upper(F.replace("part_number_raw", F.lit("-"), F.lit(""))).alias("n"), "id"), F.upper(F.replace("part_number", F.lit("-"), F.lit(""))) == F.col("n"), "left_semi")
    state, events = inventory.pull_parts(domain.appliances(spark, path), parts, known)
    return events.select("part_id", "note").join(state.select(F.col("id").alias("part_id"), "quantity", "appliance_id"), "part_id").select("part_id", "quantity", "appliance_id", "note")


_REQUESTS = "requests AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || repeat('x', CAST(p_partkey % 60 AS INTEGER)) END AS part_number, repeat('b', CAST(p_partkey % 120 AS INTEGER)) AS brand, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size % 8 END AS quantity FROM part)"


@query(f"""WITH {_REQUESTS}, r AS (SELECT id, list_filter([CASE WHEN length(part_number) NOT BETWEEN 1 AND 50 THEN 'part_number' END, CASE WHEN length(brand) > 100 THEN 'brand' END, CASE WHEN quantity < 1 THEN 'quantity' END], lambda x: x IS NOT NULL) AS reasons, quantity FROM requests)
SELECT id, CASE WHEN len(reasons) = 0 THEN coalesce(quantity, 1) ELSE quantity END AS quantity, array_to_string(reasons, ',') AS reasons FROM r""")
def p8_validate_rows(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = domain.table(spark, path, "part").select(
        key.alias("id"), F.when(key % 11 == 0, "").otherwise(F.concat("p_name", F.repeat(F.lit("x"), (key % 60).cast("int")))).alias("part_number"), F.repeat(F.lit("b"), (key % 120).cast("int")).alias("brand"),
        F.when(key % 6 == 0, None).otherwise(F.col("p_size") % 8).alias("quantity"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("note"),
    )
    valid, rejected = inventory.validate_rows(rows, "add_part")
    return valid.select("id", "quantity", F.lit("").alias("reasons")).union(rejected.select("id", "quantity", F.array_join("reasons", ",")))


def _sold(spark: SparkSession, path: str) -> DataFrame:
    return domain.order_lines(spark, path)


def _seen(spark: SparkSession, path: str) -> DataFrame:
    """Lines settled before: those of every fiftieth order."""
    return domain.table(spark, path, "lineitem").where("l_orderkey % 50 = 0").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("string").alias("line_id"), F.col("l_partkey").alias("part_id"), F.lit(1).alias("quantity_depleted"), F.lit(None).cast("string").alias("quarantine_reason")
    )


_SETTLED = f"""{_recursive(with_views('parts', 'order_lines'))},
marked AS (SELECT *, row_number() OVER (PARTITION BY order_id, line_id ORDER BY created, order_id, line_id, listing_id, quantity) AS again, CAST(order_id AS BIGINT) % 50 = 0 AS old FROM order_lines),
live AS (SELECT m.*, p.id AS part, row_number() OVER (PARTITION BY m.listing_id ORDER BY created, order_id, line_id, m.quantity) AS turn FROM marked m LEFT JOIN parts p ON p.ebay_listing_id = m.listing_id WHERE NOT old AND again = 1),
fold AS (SELECT ebay_listing_id AS listing_id, CAST(0 AS BIGINT) AS turn, CAST(quantity AS INTEGER) AS stock, listed_quantity AS listed, true AS open, false AS ok, '' AS reason FROM parts WHERE ebay_listing_id IS NOT NULL
  UNION ALL SELECT f.listing_id, l.turn, CASE WHEN f.open AND f.stock >= l.quantity AND f.listed >= l.quantity THEN f.stock - l.quantity ELSE f.stock END,
  CASE WHEN f.open AND f.stock >= l.quantity AND f.listed >= l.quantity THEN f.listed - l.quantity ELSE f.listed END, f.open AND NOT (f.stock >= l.quantity AND f.listed = l.quantity), f.open AND f.stock >= l.quantity AND f.listed >= l.quantity,
  CASE WHEN f.open AND f.stock >= l.quantity AND f.listed >= l.quantity THEN NULL WHEN f.open THEN 'Invariant violation: quantity=' || f.stock || ', listedQuantity=' || f.listed || ', sold=' || l.quantity ELSE 'No matching listing for eBay item ' || f.listing_id END
  FROM fold f JOIN live l ON l.listing_id = f.listing_id AND l.turn = f.turn + 1),
settled AS (SELECT order_id, line_id, listing_id, quantity, created, 'skipped' AS status, CAST(NULL AS BIGINT) AS part_id, 0 AS quantity_depleted, CAST(NULL AS VARCHAR) AS quarantine_reason FROM marked WHERE old OR again > 1
  UNION ALL SELECT l.order_id, l.line_id, l.listing_id, l.quantity, l.created, CASE WHEN coalesce(f.ok, false) THEN 'processed' ELSE 'quarantined' END, CASE WHEN f.reason IS NULL OR f.reason NOT LIKE 'No matching%' THEN l.part END,
  CASE WHEN coalesce(f.ok, false) THEN l.quantity ELSE 0 END, CASE WHEN l.part IS NULL THEN 'No matching listing for eBay item ' || l.listing_id ELSE f.reason END
  FROM live l LEFT JOIN fold f ON f.listing_id = l.listing_id AND f.turn = l.turn)"""


def _verdicts(spark: SparkSession, path: str) -> DataFrame:
    return settlement.settle(domain.parts(spark, path), _sold(spark, path), _seen(spark, path))


@query(f"{_SETTLED} SELECT order_id, line_id, listing_id, quantity, status, part_id, quantity_depleted, quarantine_reason FROM settled")
def set1_settle(spark: SparkSession, path: str) -> DataFrame:
    return _verdicts(spark, path).drop("created")


@query(f"{_SETTLED} SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'skipped') AS skipped FROM settled")
def a9_settlement_summary(spark: SparkSession, path: str) -> DataFrame:
    return settlement.settlement_summary(_verdicts(spark, path))


@query(f"""{_SETTLED}, sold AS (SELECT part_id, sum(quantity_depleted) AS n FROM settled WHERE status = 'processed' GROUP BY part_id)
SELECT id, CAST(quantity - coalesce(n, 0) AS INTEGER) AS quantity, CAST(listed_quantity - coalesce(n, 0) AS INTEGER) AS listed_quantity, CASE WHEN n IS NULL OR listed_quantity <> n THEN ebay_listing_id END AS ebay_listing_id FROM parts LEFT JOIN sold ON part_id = id""")
def set1_parts_after(spark: SparkSession, path: str) -> DataFrame:
    parts = domain.parts(spark, path)
    return settlement.settled_parts(parts, settlement.settle(parts, _sold(spark, path), _seen(spark, path))).select("id", "quantity", "listed_quantity", "ebay_listing_id")


@query(f"{_SETTLED} SELECT part_id, 'ebay_sold' AS event_type, -quantity_depleted AS quantity_change, 'eBay order #' || order_id AS note FROM settled WHERE status = 'processed'")
def set1_events(spark: SparkSession, path: str) -> DataFrame:
    return settlement.settlement_events(_verdicts(spark, path))


@query(f"{with_views('parts', 'order_lines')} SELECT order_id, line_id, o.listing_id, o.quantity, p.id AS part_id FROM order_lines o LEFT JOIN parts p ON p.ebay_listing_id = o.listing_id")
def j5_lines_to_parts(spark: SparkSession, path: str) -> DataFrame:
    listed = domain.parts(spark, path).where("ebay_listing_id IS NOT NULL").select(F.col("ebay_listing_id").alias("listing_id"), F.col("id").alias("part_id"))
    return _sold(spark, path).join(listed, "listing_id", "left").select("order_id", "line_id", "listing_id", "quantity", "part_id")


@query(f"{with_views('order_lines')} SELECT order_id, line_id, listing_id, quantity FROM order_lines o WHERE NOT EXISTS (SELECT 1 FROM order_lines d WHERE CAST(d.order_id AS BIGINT) % 50 = 0 AND d.order_id = o.order_id AND d.line_id = o.line_id)")
def j6_unprocessed(spark: SparkSession, path: str) -> DataFrame:
    return settlement.unprocessed(_sold(spark, path), _seen(spark, path)).select("order_id", "line_id", "listing_id", "quantity")


def _watermark(spark: SparkSession, path: str) -> DataFrame:
    """The watermark stands at the middle of the orders' time span."""
    return domain.table(spark, path, "orders").agg(F.timestamp_seconds((F.min(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) + F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))) / 2).cast("timestamp_ntz").alias("last_polled_at"))


_MARK = "mark AS (SELECT make_timestamp(CAST((epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2 * 1000000 AS BIGINT)) AS polled FROM orders)"


@query(f"{with_views('order_lines')}, {_MARK} SELECT order_id, line_id, listing_id, quantity FROM order_lines, mark WHERE created >= polled - INTERVAL 5 MINUTES AND created <= polled + INTERVAL 300 DAYS")
def str1_poll_window(spark: SparkSession, path: str) -> DataFrame:
    mark = _watermark(spark, path)
    now = mark.select(F.col("last_polled_at") + F.expr("INTERVAL 300 DAYS")).scalar()
    return settlement.poll_window(_sold(spark, path), mark, now).select("order_id", "line_id", "listing_id", "quantity")


@query(f"{with_views('order_lines')}, {_MARK} SELECT order_id, line_id, listing_id, quantity FROM order_lines, mark WHERE created < polled - INTERVAL 5 MINUTES")
def str4_late_lines(spark: SparkSession, path: str) -> DataFrame:
    return settlement.late_lines(_sold(spark, path), _watermark(spark, path)).select("order_id", "line_id", "listing_id", "quantity")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_id, 'L' || l_partkey AS listing_id, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def src2_order_lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").cast("string").alias("lineItemId"), F.concat(F.lit("L"), "l_partkey").alias("legacyItemId"), F.col("l_quantity").cast("int").alias("quantity"))
    lists = domain.table(spark, path, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lineItems"))
    orders = domain.table(spark, path, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.select(F.col("o_orderkey").cast("string").alias("orderId"), F.col("o_orderdate").alias("creationDate"), "lineItems")
    return tables.order_lines(nested).select("order_id", "line_id", "listing_id", "quantity")


_POLLED = _SETTLED.replace("marked AS (", f"{_MARK}, marked AS (", 1).replace("AS old FROM order_lines)", "AS old FROM order_lines, mark WHERE created >= polled - INTERVAL 5 MINUTES AND created <= polled + INTERVAL 300 DAYS)")


def _poll(spark: SparkSession, path: str) -> settlement.Poll:
    mark = _watermark(spark, path)
    now = mark.select(F.col("last_polled_at") + F.expr("INTERVAL 300 DAYS")).scalar()
    return settlement.poll_orders(domain.parts(spark, path), _sold(spark, path), _seen(spark, path), mark, now)


@query(f"{_POLLED} SELECT order_id, line_id, listing_id, quantity, status, part_id, quantity_depleted, quarantine_reason FROM settled")
def pipe3_poll(spark: SparkSession, path: str) -> DataFrame:
    return _poll(spark, path).verdicts.drop("created")


@query(f"{_POLLED} SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'skipped') AS skipped, (SELECT polled + INTERVAL 300 DAYS FROM mark) AS last_polled_at FROM settled")
def pipe3_poll_summary(spark: SparkSession, path: str) -> DataFrame:
    poll = _poll(spark, path)
    return poll.summary.withColumn("last_polled_at", poll.watermark.scalar())


@query(f"""{_POLLED}, sold AS (SELECT part_id, sum(quantity_depleted) AS n FROM settled WHERE status = 'processed' GROUP BY part_id)
SELECT id, CAST(quantity - coalesce(n, 0) AS INTEGER) AS quantity, CAST(listed_quantity - coalesce(n, 0) AS INTEGER) AS listed_quantity, CASE WHEN n IS NULL OR listed_quantity <> n THEN ebay_listing_id END AS ebay_listing_id FROM parts LEFT JOIN sold ON part_id = id""")
def pipe3_parts_after(spark: SparkSession, path: str) -> DataFrame:
    return _poll(spark, path).parts.select("id", "quantity", "listed_quantity", "ebay_listing_id")
