"""Queries of the catalog and of cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partflow.operators import catalog, crossref, search_index
from partflow.plans.registry import query
from partflow.sources import domain, tables
from partflow.sources.domain import with_views
from partflow.sources.scratch import shared_dir

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"{with_views('parts')} SELECT id, part_number, part_number_raw, brand, description, quantity, listed_quantity, quantity - listed_quantity AS available, ebay_listing_id, appliance_id, {_ISO.format('updated_at')} AS updated_at FROM parts")
def p1_part_view(spark: SparkSession, path: str) -> DataFrame:
    return catalog.part_view(domain.parts(spark, path))


@query(f"{with_views('ev')} SELECT id, part_id, event_type, quantity_change, note, {_ISO.format('created_at')} AS created_at FROM ev")
def p2_event_view(spark: SparkSession, path: str) -> DataFrame:
    return catalog.event_view(domain.inventory_events(spark, path))


@query(f"{with_views('appliances')} SELECT *, brand || ' ' || model_number AS title FROM appliances")
def p3_appliance_view(spark: SparkSession, path: str) -> DataFrame:
    return catalog.appliance_view(domain.appliances(spark, path))


@query(f"""{with_views('parts')}, asked AS (SELECT DISTINCT ' wp.' || lpad(CAST(l_partkey + l_orderkey % 2 * 1000000 AS VARCHAR), 8, '0') || ' ' AS request FROM lineitem)
SELECT request, upper(regexp_replace(request, '[-.\\s#]', '', 'g')) AS part_number, id, quantity, quantity - listed_quantity AS available, id IS NOT NULL AS found
FROM asked LEFT JOIN parts ON parts.part_number = upper(regexp_replace(request, '[-.\\s#]', '', 'g'))""")
def p4_lookup_exact(spark: SparkSession, path: str) -> DataFrame:
    key = F.lpad((F.col("l_partkey") + F.col("l_orderkey") % 2 * 1000000).cast("string"), 8, "0")
    asked = domain.table(spark, path, "lineitem").select(F.concat(F.lit(" wp."), key, F.lit(" ")).alias("request")).distinct()
    return catalog.lookup_exact(asked, domain.parts(spark, path))


@query(f"{with_views('parts')} SELECT id, part_number FROM parts WHERE part_number ILIKE '%P000_12%'")
def p5_search_substring(spark: SparkSession, path: str) -> DataFrame:
    return catalog.search_substring(domain.parts(spark, path), " p-000_12 ").select("id", "part_number")


_FUZZY = f"""{with_views('parts')}, asked AS (SELECT p_name || ' ' || p_partkey AS request, 'wp' || substr('0000' || CAST(p_partkey * 7 AS VARCHAR), 1, 6) || '5' AS raw FROM part WHERE p_partkey % 50 = 0),
a AS (SELECT raw AS request, lower(regexp_replace(raw, '[-.\\s#]', '', 'g')) AS term FROM (SELECT DISTINCT raw FROM asked)),
ag AS (SELECT DISTINCT request, substr('  ' || term || ' ', i, 3) AS g FROM a, unnest(range(1, length(term) + 2)) AS t(i)),
pg AS (SELECT DISTINCT id, substr('  ' || lower(part_number) || ' ', i, 3) AS g FROM parts, unnest(range(1, length(part_number) + 2)) AS t(i)),
k AS (SELECT request, id, count(*) AS k FROM ag JOIN pg ON ag.g = pg.g GROUP BY request, id),
s AS (SELECT k.request, k.id, k / (n + m - k) AS similarity, p.part_number ILIKE '%' || a.term || '%' AS holds FROM k
  JOIN (SELECT request, count(*) AS n FROM ag GROUP BY request) n ON n.request = k.request JOIN (SELECT id, count(*) AS m FROM pg GROUP BY id) m ON m.id = k.id
  JOIN parts p ON p.id = k.id JOIN a ON a.request = k.request)
SELECT request, id, similarity FROM s WHERE similarity > 0.3 OR holds"""


def _asked_numbers(spark: SparkSession, path: str) -> DataFrame:
    number = F.substring(F.concat(F.lit("0000"), (F.col("p_partkey") * 7).cast("string")), 1, 6)
    return domain.table(spark, path, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("wp"), number, F.lit("5")).alias("request"))


@query(_FUZZY)
def p6_search_fuzzy(spark: SparkSession, path: str) -> DataFrame:
    return catalog.search_fuzzy(_asked_numbers(spark, path), domain.parts(spark, path))


@query(_FUZZY)
def p6_search_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index that began with other numbers for a tenth of the parts, without another tenth, and with parts that are gone now."""
    folder, parts = shared_dir(spark, "index"), domain.parts(spark, path).select("id", "part_number")
    before = parts.where("id % 10 != 3").withColumn("part_number", F.when(F.col("id") % 10 == 4, F.concat(F.lit("OLD"), "part_number")).otherwise(F.col("part_number")))
    gone = parts.where("id % 10 = 5").select((-1 - F.col("id")).alias("id"), "part_number")
    search_index.build_index(before.unionByName(gone), folder)
    search_index.update_index(parts.where("id % 10 IN (3, 4)").unionByName(gone.withColumn("part_number", F.lit(None).cast("string"))), folder)
    return search_index.search_index(_asked_numbers(spark, path), spark, folder)


@query(f"""{with_views('parts')} SELECT id, CASE WHEN quantity = 0 THEN 'Out of stock' WHEN listed_quantity > 0 THEN (quantity - listed_quantity) || ' avail, ' || listed_quantity || ' listed'
ELSE quantity || ' in stock' END AS stock_status FROM parts""")
def p7_stock_status(spark: SparkSession, path: str) -> DataFrame:
    return catalog.stock_status(domain.parts(spark, path)).select("id", "stock_status")


@query(f"""{with_views('parts', 'xrefs', 'ev', 'appliances')}
SELECT 'unique_part_number' AS "constraint", part_number AS key, count(*) AS n FROM parts GROUP BY part_number HAVING count(*) > 1
UNION ALL SELECT 'unique_listing', ebay_listing_id, count(*) FROM parts WHERE ebay_listing_id IS NOT NULL GROUP BY ebay_listing_id HAVING count(*) > 1
UNION ALL SELECT 'unique_cross_reference', part_id || '/' || cross_ref_part_number, count(*) FROM xrefs GROUP BY part_id, cross_ref_part_number HAVING count(*) > 1
UNION ALL SELECT 'unique_event', CAST(id AS VARCHAR), count(*) FROM ev GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'part_appliance', CAST(appliance_id AS VARCHAR), count(*) FROM parts WHERE appliance_id NOT IN (SELECT id FROM appliances) GROUP BY appliance_id
UNION ALL SELECT 'event_part', CAST(part_id AS VARCHAR), count(*) FROM ev WHERE part_id NOT IN (SELECT id FROM parts) GROUP BY part_id
UNION ALL SELECT 'listed_range', CAST(id AS VARCHAR), 1 FROM parts WHERE listed_quantity < 0 OR listed_quantity > quantity""")
def p9_audit(spark: SparkSession, path: str) -> DataFrame:
    return catalog.audit(domain.parts(spark, path), domain.cross_references(spark, path), domain.inventory_events(spark, path), domain.appliances(spark, path))


_ALTERNATIVES = f"""{with_views('parts', 'xrefs')}, n AS (SELECT part_id, relationship, upper(regexp_replace(cross_ref_part_number, '[-.\\s#]', '', 'g')) AS ref FROM xrefs),
f AS (SELECT p.part_number, n.ref, n.relationship FROM parts p JOIN n ON n.part_id = p.id WHERE n.ref <> p.part_number),
b AS (SELECT p.part_number, o.part_number AS alternative, min(n.relationship) AS relationship, any_value(o.quantity) AS quantity, any_value(o.quantity - o.listed_quantity) AS available
  FROM parts p JOIN n ON n.ref = p.part_number JOIN parts o ON o.id = n.part_id WHERE o.part_number <> p.part_number GROUP BY ALL)
SELECT f.part_number, f.ref AS alternative, f.relationship, o.quantity, o.quantity - o.listed_quantity AS available, 'forward' AS side FROM f JOIN parts o ON o.part_number = f.ref WHERE o.quantity > 0
UNION ALL SELECT b.part_number, alternative, relationship, quantity, available, 'reverse' FROM b ANTI JOIN f ON f.part_number = b.part_number AND f.ref = b.alternative WHERE quantity > 0"""


@query(_ALTERNATIVES)
def alternatives(spark: SparkSession, path: str) -> DataFrame:
    parts = domain.parts(spark, path)
    return catalog.alternatives(parts.select("part_number"), parts, domain.cross_references(spark, path))


@query(f"SELECT * FROM ({_ALTERNATIVES.replace('GROUP BY ALL', 'GROUP BY ALL')}) WHERE side = 'forward'", name="j1_alternatives_forward")
def j1_alternatives_forward(spark: SparkSession, path: str) -> DataFrame:
    return alternatives(spark, path).where("side = 'forward'")


@query(f"SELECT * FROM ({_ALTERNATIVES}) WHERE side = 'reverse'", name="j2_alternatives_reverse")
def j2_alternatives_reverse(spark: SparkSession, path: str) -> DataFrame:
    return alternatives(spark, path).where("side = 'reverse'")


@query(f"""{with_views('parts', 'xrefs')} SELECT x.*, coalesce(quantity, 0) AS stock, coalesce(quantity, 0) > 0 AS in_stock FROM xrefs x
LEFT JOIN parts p ON p.part_number = upper(replace(x.cross_ref_part_number, '-', ''))""")
def j3_xrefs_with_stock(spark: SparkSession, path: str) -> DataFrame:
    return catalog.xrefs_with_stock(domain.cross_references(spark, path), domain.parts(spark, path))


@query(f"{with_views('parts', 'appliances')} SELECT a.*, p.id AS part_id, p.part_number, p.quantity, p.quantity - p.listed_quantity AS available FROM appliances a JOIN parts p ON p.appliance_id = a.id")
def j4_appliance_parts(spark: SparkSession, path: str) -> DataFrame:
    return catalog.appliance_parts(domain.appliances(spark, path), domain.parts(spark, path))


@query(f"{with_views('parts')} SELECT id, part_number, quantity FROM parts ORDER BY CASE WHEN quantity > 0 THEN 0 ELSE 1 END, updated_at DESC, id LIMIT 50 OFFSET 10")
def t1_catalog_page(spark: SparkSession, path: str) -> DataFrame:
    return catalog.catalog_page(domain.parts(spark, path), offset=10).select("id", "part_number", "quantity")


@query(f"{with_views('appliances')} SELECT id, brand FROM appliances ORDER BY id DESC LIMIT 50 OFFSET 5")
def t2_appliance_page(spark: SparkSession, path: str) -> DataFrame:
    made = F.lit(domain.EPOCH).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))
    return catalog.appliance_page(domain.appliances(spark, path).withColumn("created_at", made), offset=5).select("id", "brand")


@query(f"""{with_views('ev')} SELECT id, part_id, event_type, quantity_change FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY created_at DESC, id DESC, event_type, quantity_change) AS turn FROM ev)
WHERE turn BETWEEN 3 AND 22""")
def t3_event_page(spark: SparkSession, path: str) -> DataFrame:
    return catalog.event_page(domain.inventory_events(spark, path), offset=2).select("id", "part_id", "event_type", "quantity_change")


_LINES = """lines AS (SELECT order_id, line_id, CASE WHEN quantity = 3 THEN 'No matching listing for eBay item ' || listing_id END AS quarantine_reason, created AS processed_at FROM order_lines)"""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    reason = F.when(F.col("quantity") == 3, F.concat(F.lit("No matching listing for eBay item "), "listing_id"))
    return domain.order_lines(spark, path).select("order_id", "line_id", reason.alias("quarantine_reason"), F.col("created").alias("processed_at"))


@query(f"""{with_views('order_lines')}, {_LINES} SELECT order_id, line_id, quarantine_reason, (SELECT count(*) FROM lines WHERE quarantine_reason IS NOT NULL) AS total
FROM lines WHERE quarantine_reason IS NOT NULL ORDER BY processed_at DESC, order_id, line_id, quarantine_reason LIMIT 20 OFFSET 7""")
def t4_quarantine_page(spark: SparkSession, path: str) -> DataFrame:
    return catalog.quarantine_page(_lines(spark, path), offset=7).drop("processed_at")


@query(f"{with_views('order_lines')}, {_LINES} SELECT order_id, line_id, quarantine_reason FROM lines WHERE quarantine_reason IS NOT NULL")
def p13_quarantined(spark: SparkSession, path: str) -> DataFrame:
    return catalog.quarantined(_lines(spark, path)).drop("processed_at")


@query(f"{with_views('order_lines')}, {_LINES} SELECT count(quarantine_reason) AS quarantined FROM lines")
def a1_quarantine_count(spark: SparkSession, path: str) -> DataFrame:
    return catalog.quarantine_count(_lines(spark, path))


_MENTION = r"regexp_extract_all(title || ' ' || description, '(?i)\b(?:WP[A-Z]?\d{5,}|W\d{7,}|WB\d+X\d+|\d{7,10}|[A-Z]{2,3}\d{6,})\b')"
_MINED = f"""hits AS (SELECT r.*, p.part_number, part_number_raw FROM results r JOIN parts p ON p.id = r.part_id),
m AS (SELECT part_id, query_no, rank, url, description, part_number_raw, part_number, unnest({_MENTION}) AS raw, generate_subscripts({_MENTION}, 1) AS pos FROM hits),
n AS (SELECT *, upper(regexp_replace(raw, '[-.\\s#]', '', 'g')) AS mention FROM m),
o AS (SELECT * FROM n WHERE mention <> part_number AND NOT regexp_matches(mention, '^(AP|PS|EA)\\d+$')),
c AS (SELECT *, row_number() OVER (PARTITION BY part_id, mention ORDER BY query_no, rank, pos, url, description) AS turn, count(*) OVER (PARTITION BY part_id, mention) AS n FROM o),
mined AS (SELECT part_id, mention AS cross_ref_part_number, CASE WHEN contains(lower(description), 'replaced by') THEN 'replaced_by'
  WHEN contains(lower(description), 'replaces') AND contains(lower(description), lower(part_number_raw)) AND strpos(lower(description), lower(part_number_raw)) < strpos(lower(description), 'replaces') THEN 'replaces'
  WHEN contains(lower(description), 'replaces') THEN 'replaced_by' ELSE 'compatible' END AS relationship, url AS source_url, n AS mentions FROM c WHERE turn = 1 AND n >= 2)"""


@query(f"{with_views('parts', 'results')}, {_MINED} SELECT * FROM mined")
def a2_mine_cross_refs(spark: SparkSession, path: str) -> DataFrame:
    return crossref.mine_cross_refs(domain.search_results(spark, path), domain.parts(spark, path))


@query(f"""{with_views('parts', 'xrefs', 'results')}, {_MINED}, half AS (SELECT * FROM xrefs WHERE part_id % 2 = 0)
SELECT part_id, replace(upper(cross_ref_part_number), '-', '') AS cross_ref_part_number, relationship, source_url FROM half
UNION ALL SELECT part_id, cross_ref_part_number, relationship, source_url FROM mined m
WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.part_id = m.part_id AND replace(upper(h.cross_ref_part_number), '-', '') = m.cross_ref_part_number)""")
def pipe7_refresh_cross_refs(spark: SparkSession, path: str) -> DataFrame:
    known = domain.cross_references(spark, path).where("part_id % 2 = 0").withColumn("cross_ref_part_number", F.upper(F.replace("cross_ref_part_number", F.lit("-"), F.lit(""))))
    return crossref.refresh(known, domain.search_results(spark, path), domain.parts(spark, path))


@query(f"""{with_views('parts')} SELECT id, part_number, brand FROM parts WHERE id % 3 = 0 UNION ALL SELECT id, part_number, 'new' FROM parts WHERE id % 3 <> 0 AND id % 5 = 0""")
def snk3_insert_absent(spark: SparkSession, path: str) -> DataFrame:
    parts = domain.parts(spark, path).select("id", "part_number", "brand")
    return tables.insert_absent(parts.where("id % 3 = 0"), parts.where("id % 5 = 0").withColumn("brand", F.lit("new")), ["id", "part_number"])


@query(f"{with_views('results')} SELECT part_id, query_no, CAST(0 AS INTEGER) AS rank, title, description, url FROM results")
def src6_search_results(spark: SparkSession, path: str) -> DataFrame:
    hit = F.struct("title", "description", "url")
    packed = F.to_json(F.struct(F.struct(F.array(hit).alias("results")).alias("web")))
    return tables.search_results(domain.search_results(spark, path).select("part_id", "query_no", packed.alias("content")))


@query("SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def src1_scan(spark: SparkSession, path: str) -> DataFrame:
    customer = spark.read.schema("c_custkey long, c_name string, c_nationkey int, c_acctbal double").parquet(f"{path}/customer.parquet")
    nation = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(f"{path}/nation.parquet")
    return customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_acctbal", "n_name")
