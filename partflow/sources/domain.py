"""Domain tables derived from the star-schema tables of the test data, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def raw_number(key: str) -> F.Column:
    return F.concat(F.lit("wp-"), F.lpad(F.col(key).cast("string"), 8, "0"))


def parts(spark: SparkSession, path: str) -> DataFrame:
    suppliers = table(spark, path, "supplier").agg(F.count("*")).scalar()
    key = F.col("p_partkey")
    quantity = F.col("p_size") % 10
    listed = F.least(quantity, (key % 4).cast("int"))
    at = F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(mins=key.cast("int"))
    return table(spark, path, "part").select(
        key.alias("id"), F.upper(F.concat(F.lit("WP"), F.lpad(key.cast("string"), 8, "0"))).alias("part_number"), raw_number("p_partkey").alias("part_number_raw"),
        F.col("p_brand").alias("brand"), F.col("p_name").alias("description"), quantity.alias("quantity"), listed.alias("listed_quantity"),
        F.when(listed > 0, F.concat(F.lit("L"), key)).alias("ebay_listing_id"), (key % suppliers).alias("appliance_id"), at.alias("updated_at"),
    )


def appliances(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("brand"), F.concat(F.lit("M"), "s_nationkey").alias("model_number"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("stripped").alias("status"),
    )


def linked_parts(spark: SparkSession, path: str) -> DataFrame:
    """(order, a, b): parts on consecutive lines of an order."""
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = lines.select("l_orderkey", F.col("l_partkey").alias("b"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_partkey").alias("a"), "b")


def relationship(value: F.Column) -> F.Column:
    return F.when(value % 3 == 0, "replaces").when(value % 3 == 1, "replaced_by").otherwise("compatible")


def cross_references(spark: SparkSession, path: str) -> DataFrame:
    pairs = linked_parts(spark, path).groupBy("a", "b").agg(F.min("l_orderkey").alias("o"))
    return pairs.select(
        F.col("a").alias("part_id"), raw_number("b").alias("cross_ref_part_number"), relationship(F.col("a") + F.col("b")).alias("relationship"),
        F.concat(F.lit("https://parts.example.com/"), "o").alias("source_url"),
    )


def inventory_events(spark: SparkSession, path: str) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    return table(spark, path, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part_id"),
        F.when(flag == "A", "added").when(flag == "R", "used").otherwise("sold").alias("event_type"), F.when(flag == "A", n).otherwise(-n).alias("quantity_change"),
        F.concat(F.lit("order "), "l_orderkey").alias("note"), F.col("l_shipdate").alias("created_at"),
    )


def order_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, path, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").cast("string").alias("line_id"), F.concat(F.lit("L"), "l_partkey").alias("listing_id"),
        (F.col("l_quantity") % 3 + 1).cast("int").alias("quantity"), F.col("o_orderdate").alias("created"),
    )


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Hits whose title names a part and whose description names another, with the wording of a relationship."""
    value = F.col("a") + F.col("b")
    words = F.when(value % 3 == 0, " replaces ").when(value % 3 == 1, " replaced by ").otherwise(" fits ")
    pairs = linked_parts(spark, path)
    return pairs.select(
        F.col("a").alias("part_id"), (F.col("l_orderkey") % 3).alias("query_no"), F.col("l_orderkey").alias("rank"), raw_number("a").alias("title"),
        F.concat(F.regexp_replace(raw_number("a"), "-", ""), words, F.regexp_replace(raw_number("b"), "-", "")).alias("description"),
        F.concat(F.lit("https://parts.example.com/"), "l_orderkey").alias("url"),
    )


def invoice_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of invoices: (doc_id, part_number, quantity, cents), prices in quarters so that sums of doubles are exact in any order."""
    cents = (F.floor(F.col("l_extendedprice") * 4 / F.col("l_quantity")) * 25).cast("long")
    return table(spark, path, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.upper(F.regexp_replace(raw_number("l_partkey"), "-", "")).alias("part_number"), F.col("l_quantity").cast("long").alias("quantity"), cents.alias("cents"))


def money(cents: F.Column) -> F.Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def invoice_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a tab-delimited invoice for each order, with subtotal, shipping, tax and total."""
    line = F.concat_ws("\t", "part_number", "quantity", money(F.col("cents")))
    lines = invoice_items(spark, path).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.sum(F.col("quantity") * F.col("cents")).alias("sub")
    )
    ship, tax = F.col("doc_id") % 900 + 100, F.floor(F.col("sub") * 7 / 100)
    tail = [F.concat(F.lit(f"{name}: "), money(v)) for name, v in (("Subtotal", F.col("sub")), ("Shipping", ship), ("Tax", tax), ("Total", F.col("sub") + ship + tax))]
    head = [F.concat(F.lit("Order Number: "), "doc_id", F.lit(" from www.parts"), F.col("doc_id") % 3, F.lit(".com")), F.lit("Part Number\tQty\tUnit Price\tLine")]
    body = F.transform("lines", lambda x: F.concat(x, F.lit("\tea")))
    return lines.select("doc_id", F.array_join(F.concat(F.array(*head), body, F.array(*tail)), "\n").alias("text"))


SQL = {
    "parts": f"""parts AS (SELECT p_partkey AS id, 'WP' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS part_number, 'wp-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS part_number_raw,
  p_brand AS brand, p_name AS description, p_size % 10 AS quantity, CAST(least(p_size % 10, p_partkey % 4) AS INTEGER) AS listed_quantity,
  CASE WHEN least(p_size % 10, p_partkey % 4) > 0 THEN 'L' || p_partkey END AS ebay_listing_id, p_partkey % (SELECT count(*) FROM supplier) AS appliance_id,
  TIMESTAMP '{EPOCH}' + to_minutes(p_partkey) AS updated_at FROM part)""",
    "appliances": """appliances AS (SELECT s_suppkey AS id, s_name AS brand, 'M' || s_nationkey AS model_number,
  CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'stripped' END AS status FROM supplier)""",
    "linked": """linked AS (SELECT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y
  ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1)""",
    "xrefs": """xrefs AS (SELECT a AS part_id, 'wp-' || lpad(CAST(b AS VARCHAR), 8, '0') AS cross_ref_part_number,
  CASE (a + b) % 3 WHEN 0 THEN 'replaces' WHEN 1 THEN 'replaced_by' ELSE 'compatible' END AS relationship,
  'https://parts.example.com/' || min(l_orderkey) AS source_url FROM linked GROUP BY a, b)""",
    "ev": """ev AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part_id, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'used' ELSE 'sold' END AS event_type,
  CAST(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE -l_quantity END AS INTEGER) AS quantity_change, 'order ' || l_orderkey AS note, l_shipdate AS created_at FROM lineitem)""",
    "order_lines": """order_lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_id, 'L' || l_partkey AS listing_id,
  CAST(l_quantity % 3 + 1 AS INTEGER) AS quantity, o_orderdate AS created FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "results": """results AS (SELECT a AS part_id, l_orderkey % 3 AS query_no, l_orderkey AS rank, 'wp-' || lpad(CAST(a AS VARCHAR), 8, '0') AS title,
  'wp' || lpad(CAST(a AS VARCHAR), 8, '0') || CASE (a + b) % 3 WHEN 0 THEN ' replaces ' WHEN 1 THEN ' replaced by ' ELSE ' fits ' END || 'wp' || lpad(CAST(b AS VARCHAR), 8, '0') AS description,
  'https://parts.example.com/' || l_orderkey AS url FROM linked)""",
    "inv": """inv AS (SELECT l_orderkey AS doc_id, 'WP' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS part_number, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(floor(l_extendedprice * 4 / l_quantity) * 25 AS BIGINT) AS cents FROM lineitem)""",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they need."""
    needs = {"xrefs": ["linked"], "results": ["linked"]}
    ordered: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    return "WITH " + ",\n".join(SQL[n] for n in ordered)
