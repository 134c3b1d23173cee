"""Queries of the column functions over documents, part labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partflow.functions import text as t
from partflow.plans.registry import query
from partflow.sources import domain, tables
from partflow.sources.domain import with_views


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "documents").select("doc_id", "text")


_LABELS = """labels_of AS (SELECT p_partkey AS id, 'Whirlpool ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' Model No: ' WHEN 1 THEN ' M/N ' WHEN 2 THEN ' mod. ' ELSE ' made ' END || 'MX' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')
  || CASE p_partkey % 3 WHEN 0 THEN ' Serial Number: ' WHEN 1 THEN ' S/N ' ELSE ' batch ' END || 'SN' || lpad(CAST(p_partkey * 7 AS VARCHAR), 7, '0')
  || CASE p_partkey % 5 WHEN 0 THEN ' washing machine' WHEN 1 THEN ' Fridge' WHEN 2 THEN ' Heat Pump' ELSE ' box' END
  || ' wp' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || ' DD81-' || lpad(CAST(p_partkey AS VARCHAR), 8, '1') || 'A and AP' || lpad(CAST(p_partkey AS VARCHAR), 8, '2') AS text FROM part)"""


def _labels(spark: SparkSession, path: str) -> DataFrame:
    """Label texts of all parts. A file of parts is small and few tasks read it, so its rows are dealt to as many as a shuffle has before the texts are searched."""
    key = F.col("p_partkey")

    def pick(n: int, *words: str) -> F.Column:
        out = F.lit(words[-1])
        for i, w in reversed(list(enumerate(words[:-1]))):
            out = F.when(key % n == i, w).otherwise(out)
        return out

    pad = lambda c, n, ch: F.lpad(c.cast("string"), n, ch)
    text = F.concat(
        F.lit("Whirlpool "), "p_name", pick(4, " Model No: ", " M/N ", " mod. ", " made "), F.lit("MX"), pad(key, 6, "0"), pick(3, " Serial Number: ", " S/N ", " batch "), F.lit("SN"), pad(key * 7, 7, "0"),
        pick(5, " washing machine", " Fridge", " Heat Pump", " box"), F.lit(" wp"), pad(key, 8, "0"), F.lit(" DD81-"), pad(key, 8, "1"), F.lit("A and AP"), pad(key, 8, "2"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return domain.table(spark, path, "part").select("p_partkey", "p_name").repartition(parts, "p_partkey").select(key.alias("id"), text.alias("text"))


@query(f"{with_views('parts')} SELECT id, upper(regexp_replace(' ' || part_number_raw || '.' || brand || ' #', '[-.\\s#]', '', 'g')) AS normalized FROM parts")
def s1_normalize_part_number(spark: SparkSession, path: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "part_number_raw", F.lit("."), "brand", F.lit(" #"))
    return domain.parts(spark, path).select("id", t.normalize_part_number(raw).alias("normalized"))


@query(f"{with_views('parts')} SELECT id, regexp_replace(trim(' ##' || part_number_raw || '  '), '^#+', '') AS cleaned FROM parts")
def s2_clean_raw_number(spark: SparkSession, path: str) -> DataFrame:
    return domain.parts(spark, path).select("id", t.clean_raw_number(F.concat(F.lit(" ##"), "part_number_raw", F.lit("  "))).alias("cleaned"))


def _numbers_sql() -> str:
    """The formats as SQL: finds of each, the first format of a number, the place of its first mention as a word of its own."""
    shape = lambda k, x: f"SELECT src, id, text, {k} AS k, upper(unnest(regexp_extract_all(text, '(?i)\\b({x})\\b', 1))) AS pn FROM every"
    finds = " UNION ALL ".join(shape(k, x) for k, x in enumerate(t.PART_NUMBER_FORMATS))
    return f"""every AS (SELECT 0 AS src, id, text FROM labels_of UNION ALL SELECT 1, doc_id, text FROM documents), finds AS ({finds}),
    firsts AS (SELECT src, id, pn, min(k) AS k, any_value(text) AS text FROM finds GROUP BY src, id, pn), placed AS (SELECT src, id, pn, k, length(regexp_extract(text, '(?is)^(.*?)\\b' || pn || '\\b', 1)) AS spot FROM firsts),
    numbers AS (SELECT src, id, list(pn ORDER BY spot, k, pn) AS numbers FROM placed GROUP BY src, id)"""


@query(f"WITH {_LABELS}, {_numbers_sql()} SELECT e.id, CASE WHEN text IS NOT NULL THEN coalesce(numbers, CAST([] AS VARCHAR[])) END AS numbers FROM every e LEFT JOIN numbers n ON n.src = e.src AND n.id = e.id")
def s3_find_part_numbers(spark: SparkSession, path: str) -> DataFrame:
    return _labels(spark, path).union(_docs(spark, path)).select("id", t.find_part_numbers(F.col("text")).alias("numbers"))


_MENTIONS = r"list_filter(list_transform(regexp_extract_all(text, '(?i)\b(?:MENTIONS)\b'), lambda m: upper(regexp_replace(m, '[-.\s#]', '', 'g'))), lambda m: NOT regexp_matches(m, '^(AP|PS|EA)\d+$'))".replace("MENTIONS", t.MENTION_FORMATS)


@query(f"WITH {_LABELS} SELECT id, {_MENTIONS} AS mentions FROM labels_of UNION ALL SELECT doc_id, {_MENTIONS} FROM documents")
def s4_mine_mentions(spark: SparkSession, path: str) -> DataFrame:
    return _labels(spark, path).union(_docs(spark, path)).select("id", t.mine_mentions(F.col("text")).alias("mentions"))


@query(rf"SELECT doc_id, lower(nullif(regexp_extract(text, '(?i)\b({'|'.join(t.BRANDS)})\b', 1), '')) AS brand FROM documents")
def s5_find_brand(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", t.find_brand(F.col("text")).alias("brand"))


@query(f"""{with_views('results')} SELECT part_id, rank, description, CASE WHEN contains(lower(description), 'replaced by') THEN 'replaced_by'
WHEN contains(lower(description), 'replaces') AND contains(lower(description), replace(title, '-', '')) AND strpos(lower(description), replace(title, '-', '')) < strpos(lower(description), 'replaces') THEN 'replaces'
WHEN contains(lower(description), 'replaces') THEN 'replaced_by' ELSE 'compatible' END AS relationship FROM results""")
def s6_classify_relationship(spark: SparkSession, path: str) -> DataFrame:
    return domain.search_results(spark, path).select("part_id", "rank", "description", t.classify_relationship(F.col("description"), F.replace("title", F.lit("-"), F.lit(""))).alias("relationship"))


def _first(patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in patterns) + ")"


@query(f"""WITH {_LABELS} SELECT id, {_first(t.MODEL_LABELS)} AS model_number, {_first(t.SERIAL_LABELS)} AS serial_number,
lower(nullif(regexp_extract(text, '(?i)\\b({'|'.join(t.LABEL_BRANDS)})\\b', 1), '')) AS brand,
CASE lower(regexp_extract(text, '(?i)\\b({'|'.join(t.APPLIANCE_TYPES)})\\b', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in t.APPLIANCE_TYPES.items())} END AS appliance_type,
{_first(t.PART_LABELS)[:-1]}, {', '.join(f"nullif(regexp_extract(text, '(?i)\\b({p})\\b', 1), '')" for p in t.PART_SHAPES)}, nullif(regexp_extract(text, '\\b(\\d{{5,8}}[A-Z]?)\\b', 1), '')) AS part_number FROM labels_of""")
def s7_label_fields(spark: SparkSession, path: str) -> DataFrame:
    return _labels(spark, path).select("id", t.label_fields(F.col("text")).alias("f"), t.label_part_number(F.col("text")).alias("part_number")).select("id", "f.*", "part_number")


@query(r"""SELECT doc_id, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: len(string_split(x, chr(9))) >= 4)) >= 2 THEN 'tab-delimited' WHEN regexp_matches(text, '(?i)\d+\s+of:') THEN 'n-of'
WHEN regexp_matches(text, '(?i)quantity\s{2,}item\s*name') OR regexp_matches(text, '(?i)item\s*#?\s{2,}description') OR regexp_matches(text, '(?i)part\s*(?:number|#)\s{2,}') OR regexp_matches(text, '(?i)qty\s{2,}.*price') THEN 'space-aligned'
ELSE 'labeled' END AS layout FROM documents""")
def s9_layout_type(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", t.layout_type(F.col("text")).alias("layout"))


_S = r"[\s ﻿]"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '(?m)^#+\s*', '', 'g'), '\[.*?\]\(.*?\)', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"""


@query(f"SELECT page_id, CASE WHEN length({_CLEAN.format('html')}) >= 20 THEN md5({_CLEAN.format('html')}) END AS cleaned FROM pages")
def s10_clean_markup(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "pages").select("page_id", F.md5(t.clean_markup(F.col("html"))).alias("cleaned"))


REDACTED = (
    r"""regexp_replace(regexp_replace(text, '[\w.-]+@[\w.-]+\.\w{2,}', '[EMAIL]', 'g'), '\b(\d{3})-(\d{7})-(\d{7})\b', '\1-' || chr(1) || '\2' || chr(1) || '-\3', 'g')"""
)
REDACTED = rf"replace(regexp_replace({REDACTED}, '\b\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}\b', '[PHONE]', 'g'), chr(1), '')"
REDACTED = rf"regexp_replace(regexp_replace({REDACTED}, '(?i)\b\d+\s+[A-Z][a-z]+\s+({t.STREET_WORDS})\b[^,]*', '[ADDRESS]', 'g'), '(?i)ending in \d{{4}}', 'ending in [XXXX]', 'g')"
REDACTED = rf"substr(regexp_replace(regexp_replace({REDACTED}, '[\s\x{{00A0}}]+', ' ', 'g'), '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g'), 1, 8000)"


@query(f"SELECT doc_id, md5({REDACTED}) AS redacted FROM documents")
def s11_redact_text(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", F.md5(t.redact_text(F.col("text"))).alias("redacted"))


@query("SELECT id, substr(sha256(array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){m}') THEN '{m}' END" for m in t.SECTION_MARKERS) + "], lambda x: x IS NOT NULL)), '|')), 1, 12) AS fingerprint FROM "
       "(SELECT doc_id AS id, text FROM documents UNION ALL SELECT o_orderkey, 'Order # ' || o_orderkey || ' Sub total / SUBTOTAL ' || o_orderpriority || ' invoice' FROM orders)")  # fmt: skip
def s14_section_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    orders = domain.table(spark, path, "orders").select("o_orderkey", F.concat(F.lit("Order # "), "o_orderkey", F.lit(" Sub total / SUBTOTAL "), "o_orderpriority", F.lit(" invoice")).alias("text"))
    return _docs(spark, path).union(orders).select(F.col("doc_id").alias("id"), t.section_fingerprint(F.col("text")).alias("fingerprint"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) || '.com' WHEN s_suppkey % 3 = 1 THEN regexp_replace(regexp_replace(lower(' ' || s_name || ' & Co'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE 'unknown' END AS vendor_key FROM supplier""")
def s15_vendor_key(spark: SparkSession, path: str) -> DataFrame:
    none = F.array().cast("array<string>")
    domains = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.concat("s_name", F.lit(".COM")))).otherwise(none)
    words = F.when(F.col("s_suppkey") % 3 == 1, F.array(F.concat(F.lit(" "), "s_name", F.lit(" & Co")))).otherwise(none)
    return domain.table(spark, path, "supplier").select(F.col("s_suppkey").alias("id"), t.vendor_key(domains, words).alias("vendor_key"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower('.WWW.' || split_part(split_part(url, '//', 2), '/', 1)), '^\.', ''), '^www\.', '') AS domain FROM pages")
def s16_normalize_domain(spark: SparkSession, path: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return domain.table(spark, path, "pages").select("page_id", t.normalize_domain(F.concat(F.lit(".WWW."), host)).alias("domain"))


@query("""WITH x AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part),
y AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM x)
SELECT id, a = b OR len(list_filter(string_split(s, ''), lambda c: contains(l, c))) / greatest(length(a), length(b), 1) > 0.7 AS matches FROM y""")
def s17_fuzzy_match(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "part").select(F.col("p_partkey").alias("id"), t.fuzzy_match(F.col("p_name"), F.col("p_type")).alias("matches"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS cents FROM lineitem")
def s18_round2(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.round2(F.col("l_extendedprice") * F.col("l_discount")).alias("cents"))


@query(r"""SELECT p_partkey AS id, coalesce(nullif(TRY_CAST(regexp_extract(p_type || ' x', '^\s*([+-]?\d+)', 1) AS INTEGER), 0), 1) AS q1, coalesce(nullif(TRY_CAST(regexp_extract(' ' || p_size || ' pcs', '^\s*([+-]?\d+)', 1) AS INTEGER), 0), 1) AS q2,
nullif(TRY_CAST(regexp_extract(regexp_replace('$' || p_size || ',' || lpad(CAST(p_partkey AS VARCHAR), 3, '0') || '.50', '[^0-9.]', '', 'g'), '^(\d*\.?\d*)', 1) AS DOUBLE), 0) AS price FROM part""")
def s19_parse_numbers(spark: SparkSession, path: str) -> DataFrame:
    price = F.concat(F.lit("$"), "p_size", F.lit(","), F.lpad(F.col("p_partkey").cast("string"), 3, "0"), F.lit(".50"))
    return domain.table(spark, path, "part").select(
        F.col("p_partkey").alias("id"), t.parse_qty(F.concat("p_type", F.lit(" x"))).alias("q1"), t.parse_qty(F.concat(F.lit(" "), "p_size", F.lit(" pcs"))).alias("q2"), t.parse_price(price).alias("price")
    )


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '9') || CAST(o_orderkey % 1000 AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '9') END AS tracking FROM orders""")
def s20_repair_tracking(spark: SparkSession, path: str) -> DataFrame:
    number = F.lpad(F.col("o_orderkey").cast("string"), 10, "9")
    text = F.concat(F.lit("Shipped\nTracking: "), number, F.lit("\n "), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 1000).cast("string")).otherwise("Total"), F.lit(" \nend"))
    return domain.table(spark, path, "orders").select(F.col("o_orderkey").alias("id"), t.repair_tracking(number, text).alias("tracking"))


@query(r"""WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '1Z' || lpad(CAST(o_orderkey AS VARCHAR), 16, 'A') WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '4') WHEN 2 THEN 'shipped' ELSE '1234 5678 9012 3456 7' END AS tracking,
CASE WHEN o_orderkey % 8 = 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '4') ELSE 'N1' END AS order_number, lower(split_part(o_orderpriority, '-', 2)) AS courier, CASE WHEN o_orderkey % 3 = 0 THEN ' Kit ' ELSE o_orderstatus || 'x' END AS brand FROM orders)
SELECT id, CASE WHEN (regexp_matches(tracking, '^\d{10,}$') OR regexp_matches(tracking, '^1Z[A-Z0-9]{16}$') OR regexp_matches(tracking, '^\d{4}\s?\d{4}\s?\d{4}\s?\d{4}')) AND tracking <> order_number THEN tracking END AS tracking,
CASE WHEN courier NOT IN COURIERS AND length(courier) >= 2 THEN courier END AS courier,
CASE WHEN lower(trim(brand)) NOT IN BRANDS AND length(trim(brand)) >= 2 THEN brand END AS brand FROM x""".replace("COURIERS", str(t.BAD_COURIERS)).replace("BRANDS", str(t.BAD_BRANDS)))
def s21_sanitize(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("o_orderkey")
    digits = F.lpad(key.cast("string"), 12, "4")
    tracking = F.when(key % 4 == 0, F.concat(F.lit("1Z"), F.lpad(key.cast("string"), 16, "A"))).when(key % 4 == 1, digits).when(key % 4 == 2, "shipped").otherwise("1234 5678 9012 3456 7")
    number = F.when(key % 8 == 1, digits).otherwise("N1")
    brand = F.when(key % 3 == 0, " Kit ").otherwise(F.concat("o_orderstatus", F.lit("x")))
    return domain.table(spark, path, "orders").select(
        key.alias("id"), t.valid_tracking(tracking, number, F.array(F.lit("X"))).alias("tracking"),
        t.valid_word(F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))), t.BAD_COURIERS).alias("courier"), t.valid_word(brand, t.BAD_BRANDS).alias("brand"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_linenumber > 1 THEN l_extendedprice END, 0) + coalesce(l_discount, 0) + coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_tax END, 0) AS total FROM lineitem")
def s23_line_total(spark: SparkSession, path: str) -> DataFrame:
    unit, tax = F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))
    return domain.table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.line_total(unit, F.col("l_discount"), tax).alias("total"))


@query(f"""{with_views('ev')}, x AS (SELECT id, event_type, created_at, floor((epoch_us(TIMESTAMP '2024-06-01 12:00:00') - epoch_us(created_at)) / 60000000) AS m FROM ev)
SELECT id, CASE event_type WHEN 'added' THEN 'Added' WHEN 'used' THEN 'Used' WHEN 'sold' THEN 'Sold' END AS label,
CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN floor(m / 60) < 24 THEN CAST(floor(m / 60) AS BIGINT) || 'h ago' WHEN floor(m / 1440) < 7 THEN CAST(floor(m / 1440) AS BIGINT) || 'd ago' ELSE strftime(created_at, '%b %-d') END AS age
FROM x""")
def s24_event_label_age(spark: SparkSession, path: str) -> DataFrame:
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    return domain.inventory_events(spark, path).select("id", t.event_label(F.col("event_type")).alias("label"), t.relative_age(F.col("created_at"), now).alias("age"))


@query("""WITH x AS (SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN ts END AS expiry, CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'error' END AS status FROM events),
y AS (SELECT *, (epoch_us(expiry) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1000000 AS s FROM x)
SELECT id, CASE WHEN s < 0 THEN 'Auth cookies may have expired' WHEN s < 86400 THEN 'Auth cookies expire within 24 hours' WHEN s < 604800 THEN 'Auth cookies expire in ' || CAST(ceil(s / 86400) AS BIGINT) || CASE WHEN ceil(s / 86400) > 1 THEN ' days' ELSE ' day' END
WHEN expiry IS NULL AND status = 'active' THEN 'No expiry data (use cookies.txt or JSON format for expiry tracking)' END AS warning FROM y""")
def s25_expiry_warning(spark: SparkSession, path: str) -> DataFrame:
    expiry, status = F.when(F.col("event_id") % 5 != 0, F.col("ts")), F.when(F.col("event_id") % 2 == 0, "active").otherwise("error")
    return domain.table(spark, path, "events").select(F.col("event_id").alias("id"), t.expiry_warning(expiry, status, F.lit(1), F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("warning"))


@query(r"""WITH x AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, regexp_matches(url, '(?i)^https://') AND host <> '' AND host <> 'localhost' AND NOT host LIKE '%.local' AND NOT host LIKE '%.internal' AND NOT regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$') AS admissible FROM x""")
def p10_url_admissible(spark: SparkSession, path: str) -> DataFrame:
    return domain.table(spark, path, "pages").select("page_id", t.url_admissible(F.col("url")).alias("admissible"))


@query("""WITH x AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN '::ffff:' ELSE '' END || CASE event_id % 5 WHEN 0 THEN '172.' WHEN 1 THEN '100.' WHEN 2 THEN '10.' WHEN 3 THEN '198.' ELSE '8.' END || CAST(user_id % 200 AS VARCHAR) || '.1.2' AS ip, event_id % 5 AS k, user_id % 200 AS n FROM events)
SELECT id, CASE k WHEN 0 THEN n BETWEEN 16 AND 31 WHEN 1 THEN n BETWEEN 64 AND 127 WHEN 2 THEN true WHEN 3 THEN n IN (18, 19) ELSE false END AS private FROM x""")
def p11_private_ip(spark: SparkSession, path: str) -> DataFrame:
    k = F.col("event_id") % 5
    start = F.when(k == 0, "172.").when(k == 1, "100.").when(k == 2, "10.").when(k == 3, "198.").otherwise("8.")
    ip = F.concat(F.when(F.col("event_id") % 7 == 0, "::ffff:").otherwise(""), start, (F.col("user_id") % 200).cast("string"), F.lit(".1.2"))
    return domain.table(spark, path, "events").select(F.col("event_id").alias("id"), t.is_private_ip(ip).alias("private"))


@query(r"""SELECT doc_id, length(x) AS n, CASE WHEN length(x) < 20 THEN 'Document appears to be empty or image-only' END AS rejected_reason
FROM (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(12), chr(10)), '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g') AS x FROM documents)""")
def src3_documents(spark: SparkSession, path: str) -> DataFrame:
    return tables.documents(_docs(spark, path)).select("doc_id", F.char_length("text").alias("n"), "rejected_reason")


@query(r"SELECT page_id, url, lower(regexp_extract(url, '(?i)^[a-z]+://([^/?#:]*)', 1)) AS host, length(html) AS n FROM pages")
def src4_pages(spark: SparkSession, path: str) -> DataFrame:
    return tables.pages(domain.table(spark, path, "pages")).select("page_id", "url", "host", F.char_length("html").alias("n"))
