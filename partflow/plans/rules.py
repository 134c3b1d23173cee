"""Queries of vendors, rules, extraction from invoice text, and pages."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from partflow.functions import text as t
from partflow.operators import extraction, pages, vendors
from partflow.plans import changes, routing, texts
from partflow.plans.registry import query
from partflow.sources import domain, schemas, tables
from partflow.sources.domain import with_views
from partflow.sources.scratch import shared_dir, stored

NOW = "2024-03-01 00:00:00"


def _many(sql: str) -> str:
    """The SQL with one vendor a customer in place of one a nation."""
    table = "nation AS (SELECT CAST(c_custkey AS INTEGER) AS n_nationkey, c_name AS n_name FROM customer)"
    return sql.replace("WITH ", f"WITH {table}, ", 1) if sql.startswith("WITH ") else f"WITH {table} {sql}"


def _vendors(spark: SparkSession, path: str, many: bool) -> DataFrame:
    if many:
        return domain.table(spark, path, "customer").select(F.col("c_custkey").cast("int").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    return domain.table(spark, path, "nation").select("n_nationkey", "n_name")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(_many(f"""{with_views('parts', 'appliances', 'xrefs', 'ev')}, seen AS (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE l_orderkey % 50 = 0)
SELECT name, n, CAST(total AS BIGINT) AS total FROM (SELECT 'parts' AS name, count(*) AS n, sum(quantity) AS total FROM parts UNION ALL SELECT 'appliances', count(*), count(brand) FROM appliances UNION ALL SELECT 'cross_references', count(*), sum(part_id) FROM xrefs
UNION ALL SELECT 'inventory_events', count(*), sum(quantity_change) FROM ev UNION ALL SELECT 'processed_lines', count(*), count(*) FROM seen UNION ALL SELECT 'vendor_templates', count(*), sum(n_nationkey % 7) FROM nation
UNION ALL SELECT 'vendor_presets', count(*), sum(n_nationkey % 5) FROM nation UNION ALL SELECT 'vendor_domains', count(*), count(*) FROM supplier)"""))
def src1_load(spark: SparkSession, path: str) -> DataFrame:
    """All stock and rule tables, written down and loaded with their declared schemas."""
    domains = domain.table(spark, path, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("d"), "s_suppkey", F.lit(".com")).alias("domain"))
    made = {
        "parts": domain.parts(spark, path), "appliances": domain.appliances(spark, path), "cross_references": domain.cross_references(spark, path), "inventory_events": domain.inventory_events(spark, path), "processed_lines": changes._seen(spark, path),
        "vendor_templates": templates(spark, path, True), "vendor_presets": _presets(spark, path), "vendor_domains": domains,
    }
    sums = {"parts": "sum(quantity)", "appliances": "count(brand)", "cross_references": "sum(part_id)", "inventory_events": "sum(quantity_change)", "processed_lines": "count(line_id)", "vendor_templates": "sum(fail_count)", "vendor_presets": "sum(fail_count)", "vendor_domains": "count(domain)"}
    folder = shared_dir(spark, "tables")
    for name, frame in made.items():
        typed = {f.name: f.dataType for f in StructType.fromDDL(schemas.STOCK_TABLES[name]) if f.name in frame.columns}
        frame.select(*(F.col(c).cast(kind).alias(c) for c, kind in typed.items())).write.parquet(f"{folder}/{name}")
    loaded = [frame.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.expr(sums[name]).cast("long").alias("total")) for name, frame in tables.load(spark, folder).items()]
    return reduce(DataFrame.unionByName, loaded)


# --- domains and detection ---

_HOSTS = r"hosts AS (SELECT page_id, lower(regexp_extract(url, '(?i)^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages), h AS (SELECT DISTINCT host, string_split(regexp_replace(host, '^www\.', ''), '.') AS l FROM hosts)"
_DOMAINS = f"{_HOSTS}, domains AS (SELECT DISTINCT array_to_string(l[len(l) - 1:], '.') AS domain FROM h UNION SELECT DISTINCT array_to_string(l[len(l) - 2:], '.') FROM h WHERE len(l) > 2 AND length(host) % 2 = 0)"


def _hosts(spark: SparkSession, path: str) -> DataFrame:
    return tables.pages(domain.table(spark, path, "pages")).select("page_id", "host")


def _domains(spark: SparkSession, path: str) -> DataFrame:
    labels = F.split(F.regexp_replace("host", r"^www\.", ""), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    hosts = _hosts(spark, path)
    return hosts.select(tail(2).alias("domain")).union(hosts.where((F.size(labels) > 2) & (F.length("host") % 2 == 0)).select(tail(3))).distinct()


@query(f"WITH {_DOMAINS} SELECT host, max_by(domain, length(domain)) AS domain FROM h JOIN domains ON regexp_replace(host, '^www\\.', '') = domain OR ends_with(regexp_replace(host, '^www\\.', ''), '.' || domain) GROUP BY host")
def j7_match_domain(spark: SparkSession, path: str) -> DataFrame:
    return vendors.match_domain(_hosts(spark, path), _domains(spark, path))


_VENDOR_DOCS = "vendor_docs AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' see https://www.parts' || doc_id % 9 || '.com/x' WHEN 1 THEN ' sold by Vendor' || doc_id % 9 || ', thanks' WHEN 2 THEN ' xVendor' || doc_id % 9 || ' no' ELSE '' END AS text FROM documents)"
_TEMPLATES = """templates AS (SELECT n_nationkey AS id, 'parts' || n_nationkey % 9 || '.com' AS domain, 'Vendor' || n_nationkey % 9 AS word, n_nationkey % 7 AS fails, n_nationkey % 4 AS wins, n_nationkey % 5 > 0 AS has_row,
  CASE WHEN n_nationkey % 3 > 0 THEN TIMESTAMP '2024-02-20 00:00:00' + to_days(CAST(n_nationkey AS INTEGER)) END AS attempt FROM nation)"""
ROW = r"(?m)^(?<partNumber>[A-Z0-9]+)\t(?<quantity>\d+)\t(?<unitPrice>[\d.]+)"


def _vendor_docs(spark: SparkSession, path: str) -> DataFrame:
    k, n = F.col("doc_id") % 6, F.col("doc_id") % 9
    tail = F.when(k == 0, F.concat(F.lit(" see https://www.parts"), n, F.lit(".com/x"))).when(k == 1, F.concat(F.lit(" sold by Vendor"), n, F.lit(", thanks"))).when(k == 2, F.concat(F.lit(" xVendor"), n, F.lit(" no"))).otherwise("")
    return domain.table(spark, path, "documents").select("doc_id", F.concat("text", tail).alias("text"))


def templates(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """A template for each nation (or customer), by nine domains and keywords; some without a row rule."""
    key = F.col("n_nationkey")
    rules = F.lit(json.dumps({"vendorName": "V", "lineItems": {"start": "Part Number\tQty[^\n]*\n", "end": "Subtotal", "row": ROW}}))
    empty = F.lit(json.dumps({"vendorName": "V", "lineItems": {"start": "", "end": "", "row": ""}}))
    tried = F.lit("2024-02-20 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=key)
    return _vendors(spark, path, many).select(
        key.cast("long").alias("id"), F.concat(F.lit("v"), key).alias("vendor_key"), F.col("n_name").alias("vendor_name"), F.array(F.concat(F.lit("PARTS"), key % 9, F.lit(".com"))).alias("vendor_domains"),
        F.array(F.concat(F.lit("Vendor"), key % 9), F.lit("abc")).alias("vendor_keywords"), F.when(key % 5 > 0, rules).otherwise(empty).alias("extraction_rules"), (key % 4).alias("success_count"), (key % 7).alias("fail_count"),
        F.when(key % 3 > 0, tried).alias("last_generation_attempt"),
    )


@query(f"""WITH {_VENDOR_DOCS}, {_TEMPLATES},
d AS (SELECT doc_id, min(id) AS template_id FROM vendor_docs JOIN templates ON list_contains(list_transform(regexp_extract_all(text, '(?i)(?:https?://)?(?:www\\.)?([a-z0-9-]+\\.[a-z]{{2,}})', 1), lambda x: lower(x)), domain) GROUP BY doc_id),
k AS (SELECT doc_id, min(id) AS template_id FROM vendor_docs JOIN templates ON regexp_matches(text, '(?i)\\b' || word || '\\b') WHERE doc_id NOT IN (SELECT doc_id FROM d) GROUP BY doc_id)
SELECT doc_id, template_id, 'domain' AS confidence FROM d UNION ALL SELECT doc_id, template_id, 'keyword' FROM k""")
def j8_j9_detect_vendor(spark: SparkSession, path: str) -> DataFrame:
    return vendors.detect_vendor(_vendor_docs(spark, path), templates(spark, path))


@query(_many(f"""WITH {_TEMPLATES} SELECT id, has_row AS usable, fails > 3 AND wins < fails AS unreliable, coalesce(attempt > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS, false) AS in_cooldown, fails + 1 > 3 AND wins < fails + 1 AS may_regenerate FROM templates"""))
def p14_template_state(spark: SparkSession, path: str) -> DataFrame:
    return vendors.template_state(templates(spark, path, True), _now()).select("id", "usable", "unreliable", "in_cooldown", "may_regenerate")


_OUTCOMES = "outcomes AS (SELECT event_id AS seq, user_id % 25 AS target, event_type <> 'error' AS ok FROM events)"


def _outcomes(spark: SparkSession, path: str, key: str) -> DataFrame:
    return domain.table(spark, path, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 25).alias(key), (F.col("event_type") != "error").alias("ok"))


@query(_many(f"WITH {_OUTCOMES}, {_TEMPLATES} SELECT id, CAST(any_value(wins) + count(*) FILTER (ok) AS INTEGER) AS success_count, CAST(any_value(fails) + count(*) FILTER (NOT ok) AS INTEGER) AS fail_count FROM templates LEFT JOIN outcomes ON target = id GROUP BY id"))
def a6_template_counters(spark: SparkSession, path: str) -> DataFrame:
    return vendors.template_counters(templates(spark, path, True), _outcomes(spark, path, "template_id")).select("id", "success_count", "fail_count")


def _presets(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("n_nationkey")
    return _vendors(spark, path, True).select(
        key.cast("long").alias("id"), F.concat(F.lit("v"), key % 10).alias("vendor_key"), F.lit("html").alias("input_type"), F.concat(F.lit("f"), key).alias("page_fingerprint"), F.lit("{}").alias("selectors"), F.col("n_name").alias("sample_snippet"),
        (key % 4).alias("success_count"), (key % 5).alias("fail_count"), F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
    )


@query(_many(f"""WITH {_OUTCOMES}, l AS (SELECT target, max(seq) FILTER (ok) AS last, count(*) FILTER (ok) AS s FROM outcomes GROUP BY target),
f AS (SELECT o.target, l.last, l.s, count(*) FILTER (NOT ok AND (last IS NULL OR seq > last)) AS f FROM outcomes o JOIN l ON l.target = o.target GROUP BY ALL)
SELECT n_nationkey AS id, CAST(n_nationkey % 4 + coalesce(s, 0) AS INTEGER) AS success_count, CAST(CASE WHEN last IS NOT NULL THEN 0 ELSE n_nationkey % 5 END + coalesce(f, 0) AS INTEGER) AS fail_count,
CASE WHEN last IS NOT NULL THEN 0 ELSE n_nationkey % 5 END + coalesce(f, 0) >= 3 AS disabled FROM nation LEFT JOIN f ON target = n_nationkey"""))
def a7_preset_counters(spark: SparkSession, path: str) -> DataFrame:
    return vendors.preset_counters(_presets(spark, path), _outcomes(spark, path, "preset_id")).select(F.col("id").cast("int").alias("id"), "success_count", "fail_count", "disabled")


@query(_many("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 5 < 3"))
def p15_preset_eligible(spark: SparkSession, path: str) -> DataFrame:
    return vendors.preset_eligible(_presets(spark, path)).select(F.col("id").cast("int").alias("id"))


@query(_many("""SELECT p.page_id, CASE WHEN n.n_nationkey % 5 < 3 THEN n.n_nationkey END AS preset_id FROM pages p LEFT JOIN nation n ON n.n_nationkey = p.page_id % 40 AND n.n_nationkey % 5 < 3"""))
def j10_match_preset(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("page_id") % 40
    asked = domain.table(spark, path, "pages").select("page_id", F.concat(F.lit("v"), k % 10).alias("vendor_key"), F.lit("html").alias("input_type"), F.concat(F.lit("f"), k).alias("page_fingerprint"))
    return vendors.match_preset(asked, _presets(spark, path)).select("page_id", F.col("preset_id").cast("int").alias("preset_id"))


_COOKIES = """cookies AS (SELECT CASE user_id % 4 WHEN 0 THEN 'amazon.com' WHEN 1 THEN 'ebay.com' ELSE 'shop' || user_id % 30 || '.com' END AS domain,
  CASE event_type WHEN 'click' THEN 'session-id' WHEN 'view' THEN 'ds1' WHEN 'error' THEN 'XSID' WHEN 'signup' THEN 'theme' ELSE 'x-main' END AS name, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1700000000 + event_id END AS expiry FROM events)"""


@query(f"""WITH {_COOKIES} SELECT domain, min(expiry) FILTER (expiry <> 0 AND CASE domain WHEN 'amazon.com' THEN regexp_matches(name, '(?i)^session-id$|^at-main$|^sess-at-|^x-main$|^ubid-main$')
WHEN 'ebay.com' THEN regexp_matches(name, '(?i)^ebay$|^nonsession$|^ds1$|^s$') ELSE regexp_matches(name, '(?i)session|auth|token|sid|login') END) AS expiry FROM cookies GROUP BY domain""")
def a10_earliest_expiry(spark: SparkSession, path: str) -> DataFrame:
    k, e = F.col("user_id") % 4, F.col("event_type")
    rows = domain.table(spark, path, "events").select(
        F.when(k == 0, "amazon.com").when(k == 1, "ebay.com").otherwise(F.concat(F.lit("shop"), F.col("user_id") % 30, F.lit(".com"))).alias("domain"),
        F.when(e == "click", "session-id").when(e == "view", "ds1").when(e == "error", "XSID").when(e == "signup", "theme").otherwise("x-main").alias("name"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(1700000000 + F.col("event_id")).alias("expiry"),
    )
    return vendors.earliest_expiry(rows)


@query(_many("SELECT n_nationkey AS id, 'v' || n_nationkey AS vendor_key, n_name AS vendor_name, 1 AS domains, 2 AS keywords, n_nationkey % 4 AS success_count, n_nationkey % 7 AS fail_count FROM nation"))
def a12_template_report(spark: SparkSession, path: str) -> DataFrame:
    return vendors.template_report(templates(spark, path, True)).withColumn("id", F.col("id").cast("int"))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("s_suppkey")
    return domain.table(spark, path, "supplier").select(key.alias("seq"), F.concat(F.lit("v"), key * 3).alias("vendor_key"), F.col("s_name").alias("vendor_name"), F.array(F.lit("a.com")).alias("vendor_domains"), F.array(F.lit("word")).alias("vendor_keywords"), F.lit("{}").alias("extraction_rules"))


_RULES = json.dumps({"vendorName": "V", "lineItems": {"start": "Part Number\tQty[^\n]*\n", "end": "Subtotal", "row": ROW}}).replace("'", "''")
_NO_RULES = json.dumps({"vendorName": "V", "lineItems": {"start": "", "end": "", "row": ""}})
_OLD = f"""old AS (SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) AS id, 'v' || n_nationkey AS vendor_key, n_name AS vendor_name, ['PARTS' || n_nationkey % 9 || '.com'] AS vendor_domains, ['Vendor' || n_nationkey % 9, 'abc'] AS vendor_keywords, CASE WHEN n_nationkey % 5 > 0 THEN '{_RULES}' ELSE '{_NO_RULES}' END AS extraction_rules,
CAST(n_nationkey % 4 AS INTEGER) AS success_count, CAST(n_nationkey % 7 AS INTEGER) AS fail_count, CASE WHEN n_nationkey % 3 > 0 THEN TIMESTAMP '2024-02-20 00:00:00' + to_days(n_nationkey) END AS last_generation_attempt FROM nation)"""
_TEMPLATE_COLUMNS = ("id", "vendor_key", "vendor_name", "vendor_domains", "vendor_keywords", "extraction_rules", "success_count", "fail_count", "last_generation_attempt")


@query(_many(f"""WITH {_OLD}, new AS (SELECT s_suppkey * 3 AS k, s_suppkey, s_name FROM supplier), ids AS (SELECT k, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY s_suppkey) AS id FROM new WHERE k NOT IN (SELECT k FROM old))
SELECT coalesce(old.id, ids.id) AS id, coalesce(vendor_key, 'v' || new.k) AS vendor_key, coalesce(s_name, vendor_name) AS vendor_name, CASE WHEN new.k IS NULL THEN vendor_domains ELSE ['a.com'] END AS vendor_domains, CASE WHEN new.k IS NULL THEN vendor_keywords ELSE ['word'] END AS vendor_keywords,
CASE WHEN new.k IS NULL THEN extraction_rules ELSE '{{}}' END AS extraction_rules, CASE WHEN new.k IS NULL THEN success_count ELSE 0 END AS success_count, CASE WHEN new.k IS NULL THEN fail_count ELSE 0 END AS fail_count, CASE WHEN new.k IS NULL THEN last_generation_attempt ELSE TIMESTAMP '{NOW}' END AS last_generation_attempt
FROM old FULL JOIN new ON new.k = old.k LEFT JOIN ids ON ids.k = new.k"""))
def mut7_upsert_templates(spark: SparkSession, path: str) -> DataFrame:
    return vendors.upsert_templates(templates(spark, path, True), _candidates(spark, path), _now()).select(*_TEMPLATE_COLUMNS)


@query(_many(f"""WITH {_OLD}, tried AS (SELECT s_suppkey * 2 % 400 AS k, count(*) AS n, min(s_suppkey) AS seq, min_by(s_name, s_suppkey) AS name FROM supplier GROUP BY s_suppkey * 2 % 400), ids AS (SELECT k, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY seq) AS id FROM tried WHERE k NOT IN (SELECT k FROM old))
SELECT coalesce(old.id, ids.id) AS id, coalesce(vendor_key, 'v' || tried.k) AS vendor_key, coalesce(vendor_name, name) AS vendor_name, coalesce(vendor_domains, ['d' || seq || '.com']) AS vendor_domains, coalesce(vendor_keywords, ['key' || seq, 'any']) AS vendor_keywords,
coalesce(extraction_rules, '{{"vendorName":"' || name || '","vendorSignals":{{"domains":["d' || seq || '.com"],"keywords":["key' || seq || '","any"]}},"fields":[],"lineItems":{{"start":"","end":"","row":""}},"totals":[]}}') AS extraction_rules,
coalesce(success_count, 0) AS success_count, CAST(coalesce(fail_count, 0) + coalesce(n, 0) AS INTEGER) AS fail_count, CASE WHEN tried.k IS NULL THEN last_generation_attempt ELSE TIMESTAMP '{NOW}' END AS last_generation_attempt
FROM old FULL JOIN tried ON tried.k = old.k LEFT JOIN ids ON ids.k = tried.k"""))
def mut8_failed_attempts(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("s_suppkey")
    tried = domain.table(spark, path, "supplier").select(key.alias("seq"), F.concat(F.lit("v"), key * 2 % 400).alias("vendor_key"), F.col("s_name").alias("vendor_name"), F.array(F.concat(F.lit("d"), key, F.lit(".com"))).alias("vendor_domains"), F.array(F.concat(F.lit("key"), key), F.lit("any")).alias("vendor_keywords"))
    return vendors.record_failed_attempts(templates(spark, path, True), tried, _now()).select(*_TEMPLATE_COLUMNS)


@query(_many(f"""WITH ids AS (SELECT s_suppkey, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT n_nationkey FROM nation))
SELECT CAST(coalesce(n_nationkey, id) AS BIGINT) AS id, coalesce('v' || n_nationkey % 10, 'v' || s.s_suppkey * 2 % 10) AS vendor_key, 'html' AS input_type, coalesce('f' || n_nationkey, 'f' || s.s_suppkey * 2) AS page_fingerprint, CASE WHEN s.s_suppkey IS NULL THEN '{{}}' ELSE '{{"a":1}}' END AS selectors, CASE WHEN s.s_suppkey IS NULL THEN n_name ELSE repeat('s', 2000) END AS sample_snippet,
CAST(CASE WHEN s.s_suppkey IS NULL THEN n_nationkey % 4 ELSE 1 END AS INTEGER) AS success_count, CAST(CASE WHEN s.s_suppkey IS NULL THEN n_nationkey % 5 ELSE 0 END AS INTEGER) AS fail_count, CASE WHEN s.s_suppkey IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_used_at
FROM nation FULL JOIN supplier s ON s_suppkey * 2 = n_nationkey LEFT JOIN ids ON ids.s_suppkey = s.s_suppkey"""))
def mut9_upsert_presets(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("s_suppkey")
    learned = domain.table(spark, path, "supplier").select(key.alias("seq"), F.concat(F.lit("v"), key * 2 % 10).alias("vendor_key"), F.lit("html").alias("input_type"), F.concat(F.lit("f"), key * 2).alias("page_fingerprint"), F.lit('{"a":1}').alias("selectors"), F.repeat(F.lit("s"), 2500).alias("sample_snippet"))
    return vendors.upsert_presets(_presets(spark, path), learned, _now())


@query("""WITH o AS (SELECT event_id, user_id % 60 AS k, event_type FROM events), l AS (SELECT k, max_by(CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'needs_reauth' ELSE 'error' END, event_id) AS status FROM o WHERE event_type <> 'signup' GROUP BY k)
SELECT s_suppkey AS id, coalesce(status, 'unconfigured') AS status FROM supplier LEFT JOIN l ON k = s_suppkey""")
def mut10_domain_status(spark: SparkSession, path: str) -> DataFrame:
    e = F.col("event_type")
    outcome = F.when(e == "click", "ok").when(e == "view", "login").when(e == "signup", "captcha").otherwise("error")
    seen = domain.table(spark, path, "events").select(F.concat(F.lit("d"), F.col("user_id") % 60, F.lit(".com")).alias("domain"), F.col("event_id").alias("seq"), outcome.alias("outcome"))
    domains = domain.table(spark, path, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("d"), "s_suppkey", F.lit(".com")).alias("domain"), F.lit("unconfigured").alias("status"))
    return vendors.domain_status(domains, seen).select("id", "status")


@query("""WITH new AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0), ids AS (SELECT c_custkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey) AS id FROM new WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))
SELECT coalesce(s_suppkey, id) AS id, CASE WHEN s_suppkey IS NULL THEN 'd' || new.c_custkey ELSE 'd' || s_suppkey END || '.com' AS domain, CASE WHEN new.c_custkey IS NULL THEN s_name ELSE c_name END AS vendor_name, s_suppkey % 4 = 0 AS is_preset,
CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN new.c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(new.c_custkey AS INTEGER)) END AS auth_cookie_expiry, CASE WHEN s_suppkey % 4 = 0 THEN 'unconfigured' WHEN new.c_custkey IS NOT NULL THEN 'active' ELSE 'error' END AS status
FROM supplier FULL JOIN new ON c_custkey = s_suppkey LEFT JOIN ids ON ids.c_custkey = new.c_custkey WHERE s_suppkey IS NULL OR NOT (s_suppkey % 4 = 2)""")
def mut11_domains(spark: SparkSession, path: str) -> DataFrame:
    key, none = F.col("s_suppkey"), F.lit(None).cast("timestamp_ntz")
    domains = domain.table(spark, path, "supplier").select(key.alias("id"), F.col("s_name").alias("vendor_name"), F.concat(F.lit("d"), key, F.lit(".com")).alias("domain"), none.alias("auth_cookie_expiry"), (key % 4 == 0).alias("is_preset"), F.lit("error").alias("status"))
    expiry = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("c_custkey").cast("int"))
    loaded = domain.table(spark, path, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("www.D"), "c_custkey", F.lit(".com")).alias("domain"), F.col("c_name").alias("vendor_name"), expiry.alias("auth_cookie_expiry"))
    merged = vendors.upsert_domains(domains, loaded)
    return vendors.delete_domains(merged, domains.where("id % 2 = 0").select("id")).select("id", "domain", "vendor_name", "is_preset", "auth_cookie_expiry", "status")


@query(_many("SELECT CAST(n_nationkey AS BIGINT) AS id, 'v' || n_nationkey AS vendor_key FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey * 2 FROM supplier)"))
def mut11_delete_templates(spark: SparkSession, path: str) -> DataFrame:
    gone = domain.table(spark, path, "supplier").select((F.col("s_suppkey") * 2).alias("id"))
    return vendors.delete_templates(templates(spark, path, True), gone).select("id", "vendor_key")


# --- invoices ---

_ITEMS = f"{with_views('inv')}, items AS (SELECT doc_id, part_number, CAST(quantity AS DOUBLE) AS quantity, cents / 100.0 AS unit_price FROM inv)"


def invoice_docs(spark: SparkSession, path: str) -> DataFrame:
    """Invoices with the first template that has a row rule for a third of them."""
    return domain.invoice_texts(spark, path).withColumn("template_id", (F.col("doc_id") % 4 + 1))


def invoice_items(spark: SparkSession, path: str) -> DataFrame:
    return extraction.extract_items(invoice_docs(spark, path), extraction.parse_rules(templates(spark, path)))


@query(f"{_ITEMS} SELECT doc_id, part_number, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM items")
def ud1_extract_items(spark: SparkSession, path: str) -> DataFrame:
    return invoice_items(spark, path).select("doc_id", "part_number", "quantity", "unit_price")


_MONEY = "d AS (SELECT doc_id, sum(quantity * cents) AS sub, doc_id % 900 + 100 AS ship, CAST(floor(sum(quantity * cents) * 7 / 100) AS BIGINT) AS tax FROM inv GROUP BY doc_id)"


@query(f"{with_views('inv')}, {_MONEY} SELECT doc_id, tax / 100 AS tax, ship / 100 AS shipping FROM d")
def s22_recover_totals(spark: SparkSession, path: str) -> DataFrame:
    docs = domain.invoice_texts(spark, path).select("doc_id", "text", F.lit(0.0).alias("tax"), F.lit(0.0).alias("shipping"))
    return extraction.recover_totals(docs)


@query(f"""{with_views('inv')}, {_MONEY}, x AS (SELECT i.*, d.*, sum(quantity * (cents / 100)) OVER (PARTITION BY i.doc_id) AS subtotal, quantity * (cents / 100) AS line FROM inv i JOIN d ON d.doc_id = i.doc_id)
SELECT doc_id, part_number, quantity, round(floor(cents / 100 * 100 + 0.5) / 100, 2) AS unit_price, round(floor(floor(ship / 100 * (line / subtotal) * 100 + 0.5) / 100 / quantity * 100 + 0.5) / 100, 2) AS ship_cost,
round(floor(floor(tax / 100 * (line / subtotal) * 100 + 0.5) / 100 / quantity * 100 + 0.5) / 100, 2) AS tax_price FROM x""")
def a3_allocate_costs(spark: SparkSession, path: str) -> DataFrame:
    items = domain.invoice_items(spark, path).select("doc_id", "part_number", F.col("quantity").cast("double").alias("quantity"), (F.col("cents") / 100).alias("unit_price"))
    sub = domain.invoice_items(spark, path).groupBy("doc_id").agg(F.sum(F.col("quantity") * F.col("cents")).alias("sub"))
    totals = sub.select("doc_id", ((F.col("doc_id") % 900 + 100) / 100).alias("total_shipping"), (F.floor(F.col("sub") * 7 / 100) / 100).alias("total_tax"))
    out = extraction.allocate_costs(items, totals)
    return out.select("doc_id", "part_number", F.col("quantity").cast("long").alias("quantity"), *(F.round(c, 2).alias(c) for c in ("unit_price", "ship_cost", "tax_price")))


def _odd_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with faults of every kind, by line number and part."""
    line, key = F.col("l_linenumber"), F.col("l_partkey")
    pn = F.when(key % 7 == 0, "").when(key % 7 == 1, "--").when(key % 7 == 2, "12").otherwise(F.concat(F.lit("P"), key))
    qty = F.when(key % 5 == 0, 0.0).when(key % 5 == 1, 1.5).otherwise(F.col("l_quantity"))
    price = F.when(key % 4 == 0, -1.0).when(key % 4 == 1, 60000.0).when(key % 4 == 2, qty)
    name = F.when(F.col("l_orderkey") % 2 == 0, "same").otherwise(F.concat(F.lit("n"), key % 100))
    return domain.table(spark, path, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("item_pos"), pn.alias("part_number"), name.alias("part_name"), qty.alias("quantity"), price.alias("unit_price"))


_ODD = """odd AS (SELECT l_orderkey AS doc_id, l_linenumber AS item_pos, CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '--' WHEN 2 THEN '12' ELSE 'P' || l_partkey END AS pn, CASE WHEN l_orderkey % 2 = 0 THEN 'same' ELSE 'n' || l_partkey % 100 END AS name,
  CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1.5 ELSE l_quantity END AS qty, CASE l_partkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 60000 WHEN 2 THEN CASE l_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1.5 ELSE l_quantity END END AS price FROM lineitem)"""


@query(f"""WITH {_ODD}, p AS (SELECT doc_id, CASE WHEN length(pn) < 2 THEN 25 WHEN NOT regexp_matches(pn, '(?i)[A-Z0-9]') THEN 20 WHEN regexp_matches(pn, '^\\d{{1,2}}$') THEN 25 ELSE 0 END + CASE WHEN price < 0 THEN 20 ELSE 0 END + CASE WHEN price > 50000 THEN 10 ELSE 0 END
+ CASE WHEN qty <= 0 THEN 20 WHEN qty <> floor(qty) THEN 10 ELSE 0 END + CASE WHEN price > 0 AND price = qty THEN 15 ELSE 0 END AS n FROM odd), s AS (SELECT doc_id, CAST(greatest(0, 100 - sum(n)) AS INTEGER) AS score FROM p GROUP BY doc_id),
m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN 'Item ' || row_number() OVER (PARTITION BY doc_id ORDER BY item_pos, pn, name, qty, price NULLS FIRST) ELSE 'Item' END || ': ' AS label, row_number() OVER (PARTITION BY doc_id ORDER BY item_pos, pn, name, qty, price NULLS FIRST) AS i,
  CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS sp, CASE WHEN qty = floor(qty) THEN CAST(CAST(qty AS BIGINT) AS VARCHAR) ELSE CAST(qty AS VARCHAR) END AS sq FROM odd),
f AS (SELECT doc_id, i, list_filter([CASE WHEN length(pn) < 2 THEN label || 'missing or too-short part number' WHEN pn = '--' THEN label || 'part number "--" has no alphanumeric chars' WHEN pn = '12' THEN label || 'part number "12" looks like a number, not a part' END,
  CASE WHEN price < 0 THEN label || 'negative unit price ' || sp END, CASE WHEN price > 50000 THEN label || 'unit price ' || sp || ' seems unreasonably high' END, CASE WHEN qty <= 0 THEN label || 'quantity is ' || sq WHEN qty <> floor(qty) THEN label || 'quantity ' || sq || ' is not a whole number' END,
  CASE WHEN price > 0 AND price = qty THEN label || 'unit price equals quantity (' || sp || ') -- possible column swap' END], lambda x: x IS NOT NULL) AS msgs FROM m),
g AS (SELECT doc_id, array_to_string(flatten(list(msgs ORDER BY i)), '; ') AS failures FROM f GROUP BY doc_id)
SELECT o_orderkey AS doc_id, coalesce(score, 0) AS score, coalesce(score, 0) >= 50 AS pass, coalesce(failures, 'No items extracted') AS failures FROM orders LEFT JOIN s ON s.doc_id = o_orderkey LEFT JOIN g ON g.doc_id = o_orderkey""")
def a4_sanity_score(spark: SparkSession, path: str) -> DataFrame:
    out = extraction.sanity_score(domain.table(spark, path, "orders").select(F.col("o_orderkey").alias("doc_id")), _odd_items(spark, path))
    return out.withColumn("failures", F.array_join("failures", "; "))


@query(f"""WITH {_ODD}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(name) > 2 OR length(pn) > 2) AS known, count(*) FILTER (qty < 1 OR qty <> floor(qty)) AS bq, count(*) FILTER (price < 0.01 OR price > 50000) AS bp, count(DISTINCT name) AS d FROM odd GROUP BY doc_id),
i AS (SELECT o_orderkey AS doc_id, coalesce(n, 0) AS item_count, list_filter([CASE WHEN n IS NULL THEN 'No items extracted' END, CASE WHEN 2 * known < n THEN 'Less than 50% of items have identifiable names or part numbers' END, CASE WHEN bq > 0 THEN bq || ' items have invalid quantities' END,
CASE WHEN bp > 0 THEN bp || ' items have unreasonable prices' END, CASE WHEN n > 2 AND d = 1 THEN 'All items have identical names -- selector may be wrong' END], lambda x: x IS NOT NULL) AS issues FROM orders LEFT JOIN s ON doc_id = o_orderkey)
SELECT doc_id, item_count, len(issues) = 0 AS valid, array_to_string(issues, '; ') AS issues FROM i""")
def a5_validate_extraction(spark: SparkSession, path: str) -> DataFrame:
    out = extraction.validate_extraction(domain.table(spark, path, "orders").select(F.col("o_orderkey").alias("doc_id")), _odd_items(spark, path))
    return out.withColumn("issues", F.array_join("issues", "; "))


def _plain_items(spark: SparkSession, path: str) -> DataFrame:
    items = domain.invoice_items(spark, path).groupBy("doc_id", "part_number").agg(F.max("cents").alias("cents"))
    price = F.col("cents") / 100
    return items.select("doc_id", F.col("part_number").substr(3, 8).cast("long").alias("item_pos"), "part_number", F.concat(F.lit("Part "), "part_number").alias("part_name"), F.lit(1.0).alias("quantity"), price.alias("unit_price"))


_PLAIN = f"{with_views('inv')}, plain AS (SELECT doc_id, part_number AS pn, max(cents) / 100 AS price FROM inv GROUP BY ALL), other AS (SELECT doc_id, pn, price + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS price FROM plain WHERE NOT (doc_id % 3 = 2 AND pn LIKE '%1'))"


def _other_items(spark: SparkSession, path: str) -> DataFrame:
    kept = _plain_items(spark, path).where("NOT (doc_id % 3 = 2 AND part_number LIKE '%1')")
    return kept.withColumn("unit_price", F.col("unit_price") + F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0))


@query(f"""{_PLAIN}, c AS (SELECT b.doc_id, count(*) AS nb, count(a.pn) AS na, min(CASE WHEN abs(a.price - b.price) > 0.01 THEN b.pn END) AS far FROM plain b LEFT JOIN other a ON a.doc_id = b.doc_id AND a.pn = b.pn GROUP BY b.doc_id)
SELECT doc_id, na = nb AND far IS NULL AS agrees, CASE WHEN na < nb THEN 'Template extracted ' || na || ' items, supplied ' || nb WHEN far IS NOT NULL THEN 'Price mismatch for ' || far END AS reason FROM c""")
def j11_compare_extractions(spark: SparkSession, path: str) -> DataFrame:
    return extraction.compare_extractions(_other_items(spark, path), _plain_items(spark, path))


@query(f"""{_PLAIN}, c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(a.pn) AS na, count(b.pn) AS nb, avg(CASE WHEN a.pn IS NOT NULL AND b.pn IS NOT NULL THEN CAST(a.price = b.price AS INTEGER) END) AS p FROM plain b FULL JOIN other a ON a.doc_id = b.doc_id AND a.pn = b.pn GROUP BY ALL)
SELECT doc_id, abs(na - nb) <= 1 AND na > 0 AND coalesce(p, 0) >= 0.7 AS agrees FROM c""")
def j12_verify_positional(spark: SparkSession, path: str) -> DataFrame:
    return extraction.verify_positional(_other_items(spark, path), _plain_items(spark, path), t.fuzzy_match)


@query("""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))), lambda l: l <> '') AS lines, text FROM documents),
y AS (SELECT doc_id, text, lines, array_to_string(list_transform(lines, lambda l: CASE WHEN regexp_matches(l, '^\\$?\\d[\\d,.]*$') THEN 'n' WHEN regexp_matches(l, '^[A-Za-z][A-Za-z &/\\-#.]+:?\\s*$') AND length(l) < 40 THEN 'l' ELSE 'x' END), '') AS kinds FROM x)
SELECT doc_id, CASE WHEN len(lines) = 0 THEN NULL WHEN contains(kinds, 'nnn') THEN 'orphan-numbers' WHEN len(lines) >= 10 AND len(list_filter(lines, lambda l: length(l) <= 3)) / len(lines) > 0.4 THEN 'fragment-soup' WHEN contains(kinds, 'lllll') THEN 'label-dump'
WHEN length(text) > 200 AND contains(substr(text, length(text) // 2 + 1), substr(text, 1, least(length(text) // 2, 100))) THEN 'duplicate-text' END AS quality_issue FROM y""")
def s8_text_quality(spark: SparkSession, path: str) -> DataFrame:
    return extraction.text_quality(domain.table(spark, path, "documents").select("doc_id", "text"))


def _responses(spark: SparkSession, path: str) -> DataFrame:
    """Supplied responses for orders: fenced JSON, plain JSON, or text that is no JSON."""
    key = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit("P"), key).alias("partNumber"), F.lit("n").alias("partName"), F.lit(2.0).alias("quantity"), F.col("o_totalprice").alias("unitPrice"))
    body = F.to_json(F.struct(F.lit("V").alias("vendor"), F.concat(F.lit("N"), key).alias("orderNumber"), F.array(item).alias("items")))
    content = F.when(key % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 3 == 1, body).otherwise("sorry, no result")
    return domain.table(spark, path, "orders").select(key.alias("doc_id"), content.alias("content"))


@query("SELECT o_orderkey AS doc_id, 0 AS item_pos, 'P' || o_orderkey AS part_number, CAST(2 AS DOUBLE) AS quantity, o_totalprice AS unit_price FROM orders WHERE o_orderkey % 3 < 2")
def src5_parse_responses(spark: SparkSession, path: str) -> DataFrame:
    return tables.response_items(tables.parse_responses(_responses(spark, path))).select("doc_id", "item_pos", "part_number", "quantity", "unit_price")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 < 2 THEN 'N' || o_orderkey END AS order_number, CASE WHEN o_orderkey % 3 = 2 THEN 'sorry, no result' END AS corrupt FROM orders")
def ud3_supplied_metadata(spark: SparkSession, path: str) -> DataFrame:
    return tables.parse_responses(_responses(spark, path)).select("doc_id", F.col("response.orderNumber").alias("order_number"), "corrupt")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(text) + length(chr(10) || chr(10) || '--- OCR-enhanced text ---' || chr(10)) + length('Heading' || chr(10) || 'a & b ' || repeat('word ', 9) || 'end') ELSE length(text) END AS n FROM documents""")
def src7_supplement_text(spark: SparkSession, path: str) -> DataFrame:
    docs = domain.table(spark, path, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "label-dump").alias("quality_issue"))
    element = lambda s: F.struct(s.alias("content"), F.lit("text").alias("label"))
    first = F.lit("## Heading")
    rest = F.concat(F.lit("a &amp; b  "), F.repeat(F.lit("word "), 9), F.lit("end"))
    content = F.to_json(F.struct(F.lit("short").alias("md_results"), F.array(F.array(element(first)), F.array(element(rest))).alias("layout_details")))
    return tables.supplement_text(docs, docs.select("doc_id", content.alias("content"))).select("doc_id", F.char_length("text").alias("n"))


@query(_many("SELECT n_nationkey AS id, n_nationkey % 5 > 0 AS acceptable FROM nation"))
def s26_check_rules(spark: SparkSession, path: str) -> DataFrame:
    return extraction.check_rules(extraction.parse_rules(templates(spark, path, True))).select(F.col("id").cast("int").alias("id"), "acceptable")


@query(f"""WITH w AS (SELECT event_id AS seq, user_id % 25 AS template_id, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS turn FROM events WHERE event_type = 'click')
SELECT seq AS doc_id, template_id FROM w WHERE (template_id % 4 + turn) % 10 = 0""")
def pipe6_spot_checks(spark: SparkSession, path: str) -> DataFrame:
    done = domain.table(spark, path, "events").where("event_type = 'click'").select(F.col("event_id").alias("doc_id"), (F.col("user_id") % 25).alias("template_id"), F.col("event_id").alias("seq"))
    return extraction.spot_checks(done, templates(spark, path)).select("doc_id", "template_id")


# --- pages ---


@query(r"""WITH x AS (SELECT page_id, url, html, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', '', 'g'), '(?i)<style[\s\S]*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS n, lower(html) AS low FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)ap/signin|/signin|/login|identity\.ebay') OR contains(low, 'id="ap_email"') OR contains(low, 'id="signin-reg"') OR contains(low, 'id="userid"') THEN 'login' WHEN contains(low, 'captcha') OR contains(low, 'verify you are a human') THEN 'captcha'
WHEN n > 200 OR ((contains(html, 'id="root"') OR contains(html, 'id="app"') OR contains(html, 'id="__next"')) AND n > 100) THEN 'contentful' ELSE 'empty' END AS kind FROM x""")
def p12_classify_page(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "pages").select("page_id", pages.classify_page(F.col("html"), F.col("url")).alias("kind"))


# The pages of the test tables have one shape: head, one menu, a comment, an advertisement, an article of paragraphs in which
# a bold mark is never closed (what follows lies inside it), and a footer. SQL can say what the document tree gives for it.
# Titles are cut at a length, also inside a character reference: HTML reads &amp, &lt, &gt and &quot without their semicolon, too.
_ARTICLE = "a AS (SELECT page_id, html, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS article FROM pages)"
_KINDS = f"{_ARTICLE}, k AS (SELECT page_id, html, article, substr(sha256('h1' || repeat('|p', (length(split_part(article, '<b>', 1)) - length(replace(split_part(article, '<b>', 1), '<p>', ''))) // 3)), 1, 12) AS page_fingerprint FROM a)"
_MENU = f"{_KINDS}, m AS (SELECT page_id, article, page_fingerprint, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a[^>]*>([^<]*)</a>', 1) AS names, (instr('0123456789abcdef', substr(page_fingerprint, 1, 1)) - 1) % 5 AS fails FROM k)"
_BARE = "regexp_replace(regexp_replace(html, '<!DOCTYPE html>|<!--.*?-->|<meta[^>]*>', '', 'gs'), '<script.*?</script>|<style.*?</style>', '', 'gs')"


@query(f"WITH d AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BARE}, '<nav>.*?</nav>|<footer>.*?</footer>', '', 'gs'), '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g') AS text FROM pages) SELECT doc_id AS page_id, {texts.REDACTED} AS redacted FROM d")
def s11_redact_html(spark: SparkSession, path: str) -> DataFrame:
    return pages.redact_html(domain.table(spark, path, "pages"))


@query(f"""WITH {_ARTICLE}, c AS (SELECT page_id, replace(html, '</article>', repeat('</b></p>', (length(article) - length(replace(article, '<b>', ''))) // 3) || '</article>') AS html FROM a)
SELECT page_id, substr(replace(replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace({_BARE}, '<(html|a) [^>]*>', '<\\1>', 'g'), ' href="[^"]*"', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;?', '"', 'g'), '&(amp|lt|gt);?', chr(1) || '\\1;', 'g'), '&', '&amp;'), chr(1), '&') || CASE WHEN contains(html, '</body>') THEN '' ELSE '</body></html>' END, 1, 8000) AS skeleton FROM c""")
def s12_scrub_html(spark: SparkSession, path: str) -> DataFrame:
    return pages.scrub_html(domain.table(spark, path, "pages"))


@query(f"WITH {_KINDS} SELECT page_id, page_fingerprint FROM k")
def s13_page_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    return pages.page_fingerprint(domain.table(spark, path, "pages"))


SELECTORS = json.dumps({"itemContainer": "nav li", "fields": {"partName": "a", "quantity": ".none", "unitPrice": ".none"}, "orderFields": {"orderNumber": "h1", "totalTax": "article p"}})


def _fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, page_fingerprint) of all pages, worked out once."""
    return stored(pages.page_fingerprint(domain.table(spark, path, "pages")), "fingerprints")


def _page_presets(fingerprints: DataFrame) -> DataFrame:
    """A preset for each structure that pages have."""
    seen = fingerprints.select("page_fingerprint").distinct()
    return seen.select(F.xxhash64("page_fingerprint").alias("id"), F.lit("v").alias("vendor_key"), F.lit("html").alias("input_type"), "page_fingerprint", F.lit(SELECTORS).alias("selectors"), ((F.instr(F.lit("0123456789abcdef"), F.substring("page_fingerprint", 1, 1)) - 1) % 5).alias("fail_count"))


_TAXED = r"""p AS (SELECT page_id, names, regexp_replace(CASE WHEN starts_with(rest, '<b>') THEN rest ELSE split_part(rest, '</p>', 1) END, '<[^>]*>', '', 'g') AS first FROM (SELECT page_id, names, substr(article, instr(article, '<p>') + 3) AS rest FROM m)),
t AS (SELECT page_id, names, coalesce(TRY_CAST(regexp_extract(regexp_replace(first, '[^0-9.]', '', 'g'), '^(\d*\.?\d*)', 1) AS DOUBLE), 0) AS tax FROM p)"""


@query(f"""WITH {_MENU}, {_TAXED}, i AS (SELECT page_id, tax, len(names) AS n, unnest(names) AS part_name, generate_subscripts(names, 1) - 1 AS item_pos FROM t)
SELECT page_id AS doc_id, CAST(item_pos AS INTEGER) AS item_pos, '' AS part_number, part_name, CAST(1 AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS unit_price, lower(nullif(regexp_extract(part_name, '(?i)\\b({'|'.join(t.BRANDS)})\\b', 1), '')) AS brand,
CAST(0 AS DOUBLE) AS ship_cost, floor(tax * (1.0 / n) * 100 + 0.5) / 100 AS tax_price FROM i""")
def ud2_extract_page_items(spark: SparkSession, path: str) -> DataFrame:
    found, kinds = domain.table(spark, path, "pages"), _fingerprints(spark, path)
    marked = found.join(kinds, "page_id").select("page_id", "html", F.xxhash64("page_fingerprint").alias("preset_id"))
    return pages.extract_page_items(marked, _page_presets(kinds))[1]


_VALID = f"{_MENU}, v AS (SELECT page_id, names, len(names) AS n, fails < 3 AND len(names) > 0 AND 2 * len(list_filter(names, lambda x: length(x) > 2)) >= len(names) AND NOT (len(list_filter(names, lambda x: x <> '')) > 2 AND len(list_distinct(list_filter(names, lambda x: x <> ''))) = 1) AS good FROM m)"


@query(f"WITH {_VALID} SELECT page_id, CASE WHEN good THEN 'preset' WHEN page_id % 3 = 0 THEN 'llm' ELSE 'empty' END AS source, CAST(CASE WHEN good THEN n WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS item_count FROM v")
def pipe2_page_chain(spark: SparkSession, path: str) -> DataFrame:
    found = domain.table(spark, path, "pages")
    supplied = found.where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("item_pos"), F.lit("WP12345678").alias("part_number"), F.lit("Belt").alias("part_name"), F.lit(1.0).alias("quantity"), F.lit(9.5).alias("unit_price"))
    return pages.page_chain(found, _page_presets(_fingerprints(spark, path)), supplied, F.lit("v"))


@query(f"WITH {_VALID.replace('fails < 3 AND ', '')} SELECT page_id AS doc_id, page_id % 3 = 2 AS agrees FROM v WHERE good")
def pipe5_selector_acceptance(spark: SparkSession, path: str) -> DataFrame:
    found, kinds = domain.table(spark, path, "pages"), _fingerprints(spark, path)
    marked = found.join(kinds, "page_id").select("page_id", "html", F.xxhash64("page_fingerprint").alias("preset_id"))
    _, items = pages.extract_page_items(marked, _page_presets(kinds))
    valid = extraction.validate_extraction(found.select(F.col("page_id").alias("doc_id")), items).where("valid").select("doc_id")
    names = F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav.*?</nav>", 0), F.lit("<li><a[^>]*>([^<]*)</a>"), F.lit(1))
    supplied = found.select(F.col("page_id").alias("doc_id"), F.posexplode(names).alias("item_pos", "name"))  # a third has other names, a third prices that pages lack
    supplied = supplied.select("doc_id", "item_pos", F.when(F.col("doc_id") % 3 == 0, "#~#").otherwise(F.col("name")).alias("part_name"), F.when(F.col("doc_id") % 3 == 1, 9.5).alias("unit_price"))
    return extraction.verify_positional(items.join(valid, "doc_id", "left_semi"), supplied.join(valid, "doc_id", "left_semi"), t.fuzzy_match)


# The whole import: pages with every fate, domains of which some are not configured, presets for some structures, supplied items
# that agree with the candidate selectors or not.
_IMPORT = f"""{_MENU}, {_DOMAINS}, f AS (SELECT page_id, url || CASE WHEN page_id % 13 = 0 THEN '/signin' ELSE '' END AS url, CASE WHEN page_id % 31 = 0 THEN '10.1.2.3' ELSE '8.8.8.8' END AS address, page_id % 29 = 0 AS lost, page_id % 17 = 0 AS robot FROM pages),
best AS (SELECT host, max_by(domain, length(domain)) AS domain FROM h JOIN domains ON regexp_replace(host, '^www\\.', '') = domain OR ends_with(regexp_replace(host, '^www\\.', ''), '.' || domain) GROUP BY host),
g AS (SELECT f.page_id, CASE WHEN f.url LIKE 'https://%' THEN domain END AS vendor_key, names, page_fingerprint, CASE WHEN f.url NOT LIKE 'https://%' THEN 'validation' WHEN length(domain) % 9 = 0 THEN 'no_cookies' WHEN lost OR address LIKE '10.%' THEN 'error' WHEN f.url LIKE '%/signin%' THEN 'login' WHEN robot THEN 'captcha' ELSE 'ok' END AS outcome
  FROM f JOIN hosts USING (page_id) JOIN best USING (host) JOIN m USING (page_id)),
presets AS (SELECT min(page_id) AS id, domain AS vendor_key, page_fingerprint, length(domain) % 4 AS fail_count FROM hosts JOIN best USING (host) JOIN m USING (page_id) WHERE length(domain) % 3 > 0 GROUP BY domain, page_fingerprint),
v AS (SELECT *, len(names) > 0 AND 2 * len(list_filter(names, lambda x: length(x) > 2)) >= len(names) AND NOT (len(list_filter(names, lambda x: x <> '')) > 2 AND len(list_distinct(list_filter(names, lambda x: x <> ''))) = 1) AS good FROM g WHERE outcome = 'ok'),
j AS (SELECT v.page_id, v.vendor_key, v.page_fingerprint, p.id AS preset_id, good, CASE WHEN p.id IS NOT NULL AND good THEN 'preset' WHEN v.page_id % 3 = 2 OR v.page_id % 3 = 1 AND good THEN 'llm' ELSE 'empty' END AS source, len(names) AS n FROM v LEFT JOIN presets p ON p.vendor_key = v.vendor_key AND p.page_fingerprint = v.page_fingerprint AND p.fail_count < 3)"""


def _import(spark: SparkSession, path: str) -> pages.PageImport:
    key = F.col("page_id")
    found = domain.table(spark, path, "pages").select(
        "page_id", F.concat("url", F.when(key % 13 == 0, "/signin").otherwise("")).alias("url"), F.when(key % 31 == 0, "10.1.2.3").otherwise("8.8.8.8").alias("address"),
        F.when(key % 29 != 0, F.concat("html", F.when(key % 17 == 0, "<!-- captcha -->").otherwise(""))).alias("html"),
    )
    length = F.length("domain")
    domains = _domains(spark, path).select(F.xxhash64("domain").alias("id"), "domain", F.when(length % 9 == 0, "unconfigured").otherwise("new").alias("status"))
    plain = domain.table(spark, path, "pages")
    hosts = _hosts(spark, path).join(vendors.match_domain(_hosts(spark, path), domains), "host").join(pages.page_fingerprint(plain), "page_id")
    kinds = hosts.where("length(domain) % 3 > 0").groupBy(F.col("domain").alias("vendor_key"), "page_fingerprint").agg(F.min("page_id").alias("id"))
    presets = kinds.select(
        "id", "vendor_key", F.lit("html").alias("input_type"), "page_fingerprint", F.lit(SELECTORS).alias("selectors"), F.lit("old").alias("sample_snippet"),
        F.lit(0).alias("success_count"), (F.length("vendor_key") % 4).alias("fail_count"), F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
    )
    names = F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav.*?</nav>", 0), F.lit("<li><a[^>]*>([^<]*)</a>"), F.lit(1))
    given = plain.where("page_id % 3 > 0").select(F.col("page_id").alias("doc_id"), F.posexplode(F.when(key % 3 == 1, names).otherwise(F.array(F.lit("#~#")))).alias("item_pos", "part_name"))
    given = given.select("doc_id", "item_pos", F.lit("").alias("part_number"), "part_name", F.lit(1.0).alias("quantity"), F.when(F.col("doc_id") % 3 == 2, 9.5).alias("unit_price"))
    return pages.import_pages(found, stored(presets, "presets"), domains, given, plain.select("page_id", F.lit(SELECTORS).alias("selectors")), _now())


@query(f"WITH {_IMPORT} SELECT page_id, outcome, g.vendor_key, CASE WHEN outcome = 'ok' THEN g.page_fingerprint END AS page_fingerprint, source, CAST(CASE WHEN source = 'empty' THEN 0 WHEN source = 'llm' AND page_id % 3 = 2 THEN 1 ELSE n END AS BIGINT) AS item_count FROM g LEFT JOIN j USING (page_id)")
def pipe2_import_pages(spark: SparkSession, path: str) -> DataFrame:
    return _import(spark, path).results.drop("raw_text")


@query(f"""WITH {_IMPORT}, t AS (SELECT preset_id, max(page_id) FILTER (good) AS last, count(*) FILTER (good) AS s FROM j WHERE preset_id IS NOT NULL GROUP BY preset_id),
c AS (SELECT j.preset_id, last, s, count(*) FILTER (NOT good AND (last IS NULL OR page_id > last)) AS more FROM j JOIN t USING (preset_id) GROUP BY ALL),
n AS (SELECT vendor_key, page_fingerprint, max(page_id) AS seq FROM j WHERE source = 'llm' AND good AND page_id % 3 = 1 GROUP BY ALL),
i AS (SELECT n.*, (SELECT max(id) FROM presets) + row_number() OVER (ORDER BY seq) AS new_id FROM n ANTI JOIN presets p ON p.vendor_key = n.vendor_key AND p.page_fingerprint = n.page_fingerprint)
SELECT CAST(coalesce(p.id, new_id) AS BIGINT) AS id, vendor_key, page_fingerprint, CAST(CASE WHEN n.seq IS NOT NULL THEN 1 ELSE coalesce(s, 0) END AS INTEGER) AS success_count,
CAST(CASE WHEN n.seq IS NOT NULL THEN 0 ELSE CASE WHEN last IS NULL THEN fail_count ELSE 0 END + coalesce(more, 0) END AS INTEGER) AS fail_count
FROM presets p FULL JOIN n USING (vendor_key, page_fingerprint) LEFT JOIN c ON preset_id = p.id LEFT JOIN i USING (vendor_key, page_fingerprint)""")
def pipe5_presets_after(spark: SparkSession, path: str) -> DataFrame:
    return _import(spark, path).presets.select("id", "vendor_key", "page_fingerprint", "success_count", "fail_count")


@query(f"""WITH {_IMPORT}, l AS (SELECT vendor_key AS domain, max_by(CASE outcome WHEN 'ok' THEN 'active' WHEN 'login' THEN 'needs_reauth' ELSE 'error' END, page_id) AS status FROM g WHERE outcome IN ('ok', 'login', 'error') GROUP BY ALL)
SELECT domain, coalesce(status, CASE WHEN length(domain) % 9 = 0 THEN 'unconfigured' ELSE 'new' END) AS status FROM domains LEFT JOIN l USING (domain)""")
def pipe2_domains_after(spark: SparkSession, path: str) -> DataFrame:
    return _import(spark, path).domains.select("domain", "status")


# --- composites ---


_ROUTES = f"""WITH RECURSIVE {_TEMPLATES}, {with_views('inv').removeprefix('WITH ')}, o AS (SELECT DISTINCT doc_id, doc_id % 25 AS template_id FROM inv)
SELECT doc_id, template_id, CASE WHEN NOT has_row AND coalesce(attempt > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS, false) THEN 'direct-cooldown' WHEN NOT has_row THEN 'fallback-retry' WHEN fails > 3 AND wins < fails THEN 'fallback-unreliable' ELSE 'template' END AS route
FROM o JOIN templates ON id = template_id"""


@query(_ROUTES)
def pipe1_routes(spark: SparkSession, path: str) -> DataFrame:
    docs = domain.invoice_texts(spark, path).withColumn("template_id", F.col("doc_id") % 25).withColumn("confidence", F.lit("domain"))
    return routing.route_documents(docs, templates(spark, path), _now())[0].select("doc_id", "template_id", "route")


@query(f"""{with_views('inv')}, {_MONEY}, x AS (SELECT i.*, d.ship, d.tax, sum(quantity * (cents / 100)) OVER (PARTITION BY i.doc_id) AS subtotal, quantity * (cents / 100) AS line FROM inv i JOIN d ON d.doc_id = i.doc_id)
SELECT doc_id, part_number, CAST(quantity AS DOUBLE) AS quantity, round(floor(floor(ship / 100 * (line / subtotal) * 100 + 0.5) / 100 / quantity * 100 + 0.5) / 100, 2) AS ship_cost FROM x WHERE doc_id % 25 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 > 0 AND NOT (n_nationkey % 7 > 3 AND n_nationkey % 4 < n_nationkey % 7))""")
def pipe1_items(spark: SparkSession, path: str) -> DataFrame:
    docs = domain.invoice_texts(spark, path).withColumn("template_id", F.col("doc_id") % 25).withColumn("confidence", F.lit("domain"))
    _, items = routing.route_documents(docs, templates(spark, path), _now())
    return items.select("doc_id", "part_number", "quantity", F.round("ship_cost", 2).alias("ship_cost"))


def _invoice_responses(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """Supplied responses for all invoices, or for those asked for (doc_id); some lack totals, some have a courier or brand that is none."""
    key = F.col("doc_id")
    item = F.struct(F.col("part_number").alias("partNumber"), F.lit("").alias("partName"), F.col("quantity").cast("double").alias("quantity"), (F.col("cents") / 100).alias("unitPrice"), F.when(key % 2 == 0, "kit").otherwise("acme").alias("brand"))
    lines = domain.invoice_items(spark, path)
    lines = lines if asked is None else lines.join(asked, "doc_id", "left_semi")
    lists = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    number, courier = F.lpad(key.cast("string"), 12, "4").alias("trackingNumber"), F.when(key % 3 == 0, "paid").otherwise("ups").alias("deliveryCourier")
    body = F.to_json(F.struct(F.concat(F.lit("N"), key).alias("orderNumber"), number, courier, F.when(key % 4 == 0, (key % 900 + 100) / 100).alias("totalShipping"), "items"))
    return tables.parse_responses(lists.select("doc_id", body.alias("content")))


@query(f"""{_ROUTES.replace("SELECT doc_id, template_id, CASE WHEN NOT has_row", ", r AS (SELECT doc_id, template_id, CASE WHEN NOT has_row", 1)}), {_MONEY},
y AS (SELECT i.*, d.ship, d.tax, route, sum(quantity * (cents / 100)) OVER (PARTITION BY i.doc_id) AS subtotal, quantity * (cents / 100) AS line,
  row_number() OVER (PARTITION BY i.doc_id ORDER BY part_number, CASE WHEN route = 'template' THEN CAST(quantity AS VARCHAR) ELSE lpad(CAST(quantity AS VARCHAR), 9, '0') END || chr(9) || CASE WHEN route = 'template' THEN (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ELSE lpad(CAST(cents AS VARCHAR), 12, '0') END) - 1 AS item_pos
  FROM inv i JOIN d ON d.doc_id = i.doc_id JOIN r ON r.doc_id = i.doc_id)
SELECT doc_id, route, CAST(item_pos AS INTEGER) AS item_pos, part_number, CAST(quantity AS DOUBLE) AS quantity, cents / 100 AS unit_price, round(floor(floor(ship / 100 * (line / subtotal) * 100 + 0.5) / 100 / quantity * 100 + 0.5) / 100, 2) AS ship_cost,
round(floor(floor(tax / 100 * (line / subtotal) * 100 + 0.5) / 100 / quantity * 100 + 0.5) / 100, 2) AS tax_price, CASE WHEN route <> 'template' AND doc_id % 2 = 1 THEN 'acme' END AS brand, 'N' || doc_id AS order_number, lpad(CAST(doc_id AS VARCHAR), 12, '4') AS tracking_number, CASE WHEN doc_id % 3 > 0 THEN 'ups' END AS delivery_courier FROM y""")
def pipe1_all_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of the documents of every route with their metadata; ``pipe1_items`` and its SQL hold the template route alone."""
    docs = domain.invoice_texts(spark, path).withColumn("template_id", F.col("doc_id") % 25).withColumn("confidence", F.lit("domain"))
    routes, metadata, items = routing.extract_documents(docs, templates(spark, path), _now(), _invoice_responses(spark, path))
    return items.join(metadata, "doc_id").join(routes.select("doc_id", "route"), "doc_id").select("doc_id", "route", "item_pos", "part_number", "quantity", "unit_price", F.round("ship_cost", 2).alias("ship_cost"), F.round("tax_price", 2).alias("tax_price"), "brand", "order_number", "tracking_number", "delivery_courier")


@query()
def pipe1_documents(spark: SparkSession, path: str) -> DataFrame:
    """Invoices and documents from raw text to items: cleaning, quality verdict, OCR supplement, vendor detection, routes, metadata, repair and costs."""
    key = F.col("doc_id")
    invoices = domain.invoice_texts(spark, path).select("doc_id", F.concat(F.lit("\f"), "text", F.lit(" sold by Vendor"), key % 9, F.lit("\f")).alias("text"))
    prose = domain.table(spark, path, "documents").select((-1 - key).alias("doc_id"), "text")
    docs = invoices.unionByName(prose)
    content = F.to_json(F.struct(F.concat(F.lit("scanned page of document "), key, F.lit(" see https://www.parts"), F.abs(key) % 9, F.lit(".com")).alias("md_results")))
    done = routing.parse_documents(docs, templates(spark, path), _now(), _invoice_responses(spark, path), docs.select("doc_id", content.alias("content")))
    sums = lambda c: F.round(F.aggregate("items", F.lit(0.0), lambda s, x: s + x[c] * x["quantity"]), 2).alias(c)
    return done.select("doc_id", "template_id", "confidence", "quality_issue", "rejected_reason", "route", "outcome", "wants_rule", *routing.METADATA, F.size("items").alias("n_items"), sums("unit_price"), sums("ship_cost"), sums("tax_price"))


@query(f"""{_ROUTES.replace("SELECT doc_id, template_id, CASE WHEN NOT has_row", ", r AS (SELECT doc_id, template_id, CASE WHEN NOT has_row", 1)}), t AS (SELECT doc_id, template_id, row_number() OVER (PARTITION BY template_id ORDER BY doc_id) AS turn FROM r WHERE route = 'template')
SELECT CAST(id AS BIGINT) AS id, CAST(wins + count(doc_id) AS INTEGER) AS success_count, CAST(fails + count(*) FILTER ((wins + turn) % 10 = 0 AND doc_id % 7 = 0) AS INTEGER) AS fail_count FROM templates LEFT JOIN t ON template_id = id GROUP BY id, wins, fails""")
def pipe6_spot_check_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counters of templates after invoices: successes, and failures of the spot checks that ``pipe6_spot_checks`` picks; supplied items of some invoices differ."""
    docs = domain.invoice_texts(spark, path).withColumn("template_id", F.col("doc_id") % 25).withColumn("confidence", F.lit("domain"))
    known = templates(spark, path)
    outcomes, picked, items = routing.spot_checked(docs.withColumn("seq", F.col("doc_id")), known, _now())
    supplied = tables.response_items(_invoice_responses(spark, path, picked))
    other = F.when((F.col("doc_id") % 7 == 0) & (F.col("item_pos") == 0), "WP0").otherwise(F.col("part_number"))
    failed = extraction.spot_check_failures(picked, items, supplied.withColumn("part_number", other))
    outcomes = outcomes.unionByName(failed.select("template_id", "ok"))
    return vendors.template_counters(known, outcomes).select("id", "success_count", "fail_count")


@query(f"{with_views('inv')} SELECT n_nationkey AS id, n_nationkey % 5 > 0 AND n_nationkey <> 7 AS accepted FROM nation WHERE n_nationkey IN (SELECT doc_id % 25 FROM inv)")
def pipe4_rule_acceptance(spark: SparkSession, path: str) -> DataFrame:
    """Supplied items have prices; those of template 7 differ, so its rule is not accepted."""
    docs = domain.invoice_texts(spark, path).withColumn("template_id", F.col("doc_id") % 25)
    return routing.accept_rules(docs, templates(spark, path), _supplied_prices(spark, path)).select(F.col("id").cast("int").alias("id"), "accepted")


def _supplied_prices(spark: SparkSession, path: str) -> DataFrame:
    items = domain.invoice_items(spark, path)
    first = items.groupBy("doc_id", "part_number").agg(F.when(F.count("*") == 1, F.max("cents")).alias("cents"))  # a number that stands twice is supplied without a price
    price = F.col("cents") / 100 + F.when(F.col("doc_id") % 25 == 7, 0.5).otherwise(0.0)
    return first.select("doc_id", "part_number", F.lit(0).alias("item_pos"), F.lit("").alias("part_name"), price.alias("unit_price"))


@query(f"""{with_views('inv')}, {_TEMPLATES}, k AS (SELECT id, id <> 7 AND (id % 3 > 0 OR id % 6 = 0) AND id IN (SELECT doc_id % 25 FROM inv) AS ok FROM templates)
SELECT CAST(id AS BIGINT) AS id, 'v' || id AS vendor_key, ok OR has_row AS has_row, CAST(CASE WHEN ok THEN 0 ELSE wins END AS INTEGER) AS success_count, CAST(CASE WHEN ok THEN 0 ELSE fails + 1 END AS INTEGER) AS fail_count, TIMESTAMP '{NOW}' AS last_generation_attempt FROM templates JOIN k USING (id)""")
def pipe4_templates_after(spark: SparkSession, path: str) -> DataFrame:
    """Two candidates a vendor: the first is right for two thirds of them, the second for half of the others; prices of vendor 7 differ."""
    known = templates(spark, path)
    turn = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    right = json.dumps({"vendorName": "V", "lineItems": {"start": "Part Number\tQty[^\n]*\n", "end": "Subtotal", "row": ROW}})
    wrong = right.replace("[A-Z0-9]+", "[a-z]+")
    good = F.when(F.col("turn") == 0, F.col("id") % 3 > 0).otherwise(F.col("id") % 6 == 0)
    tried = known.select("id", "vendor_key", "vendor_name", "vendor_domains", "vendor_keywords", turn)
    tried = tried.select((F.col("id") * 2 + F.col("turn")).alias("seq"), *tried.columns[1:5], F.when(good, right).otherwise(wrong).alias("extraction_rules"))
    docs = domain.invoice_texts(spark, path).withColumn("vendor_key", F.concat(F.lit("v"), F.col("doc_id") % 25))
    after = routing.learn_rules(docs, tried, _supplied_prices(spark, path), known, _now())
    return after.select("id", "vendor_key", (F.get_json_object("extraction_rules", "$.lineItems.row") != "").alias("has_row"), "success_count", "fail_count", "last_generation_attempt")


_AMOUNTS = "x AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS kind, 2 * (o_orderkey % 450) + 100 AS ship, 2 * (o_orderkey % 350) + 37 AS tax FROM orders)"


@query(f"WITH {_AMOUNTS} SELECT doc_id, CASE WHEN kind IN (0, 2) THEN tax ELSE least(tax, ship) END / 100 AS tax, CASE WHEN kind IN (0, 2) THEN ship ELSE greatest(tax, ship) END / 100 AS shipping FROM x")
def s22_totals_by_sums(spark: SparkSession, path: str) -> DataFrame:
    """Totals by label, by the pair of amounts that fills the gap, by the gap alone, and with a total that is only a stand-alone amount."""
    key = F.col("o_orderkey")
    sub, ship, tax = key % 50_000 + 10_000, 2 * (key % 450) + 100, 2 * (key % 350) + 37
    lines = lambda *parts: F.concat_ws("\n", *parts)
    head = F.concat(F.lit("Sub Total  "), domain.money(sub))
    total = domain.money(sub + ship + tax)
    text = (
        F.when(key % 4 == 0, lines(F.concat(F.lit("Tax: $"), domain.money(tax)), F.concat(F.lit("Shipping & handling "), domain.money(ship)), head))
        .when(key % 4 == 1, lines(F.lit("Invoice"), head, F.concat(F.lit("$"), domain.money(ship)), domain.money(tax), domain.money(sub + 1), F.concat(F.lit("Total Amount  "), total)))
        .when(key % 4 == 2, lines(head, F.concat(F.lit("Order total "), total))).otherwise(lines(head, total, domain.money(tax), domain.money(ship)))
    )
    docs = domain.table(spark, path, "orders").select(key.alias("doc_id"), text.alias("text"), F.when(key % 4 == 2, tax / 100).otherwise(0.0).alias("tax"), F.lit(0.0).alias("shipping"))
    return extraction.recover_totals(docs)


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'MX' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') ELSE 'S' || o_orderkey END AS model_number, CASE WHEN o_orderkey % 2 = 0 THEN 'whirlpool' ELSE 'acme' END AS brand FROM orders""")
def pipe8_label_reading(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 2 == 0, F.concat(F.lit("WHIRLPOOL Model: MX"), F.lpad(key.cast("string"), 6, "0"))).otherwise("unreadable")
    orders = domain.table(spark, path, "orders")
    supplied = orders.select(key.alias("doc_id"), F.concat(F.lit("S"), key).alias("model_number"), F.lit(None).cast("string").alias("serial_number"), F.lit("acme").alias("brand"), F.lit(None).cast("string").alias("appliance_type"))
    return routing.read_labels(orders.select(key.alias("doc_id"), text.alias("text")), supplied).select("doc_id", "model_number", "brand")
