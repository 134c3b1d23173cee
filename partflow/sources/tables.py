"""Readers and writers of stock tables, orders, documents, pages, search results and supplied responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partflow.functions.text import clean_markup, let, trim_all
from partflow.sources import schemas


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stock tables below a folder, with their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.STOCK_TABLES.items()}


def order_lines(orders: DataFrame) -> DataFrame:
    """One row a line of nested sold orders, ordered inside an order by ``pos``; orders without lines give none."""
    line = F.posexplode("lineItems").alias("pos", "line")
    return orders.select(F.col("orderId").alias("order_id"), F.col("creationDate").alias("created"), line).select(
        "order_id", F.col("line.lineItemId").alias("line_id"), F.col("line.legacyItemId").alias("listing_id"), F.col("line.quantity").alias("quantity"), "created", "pos"
    )


_CORRUPT = "_corrupt"


def read_orders(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Sold orders from files of JSON lines, as a table or as a stream of the files as they come.

    The schema is declared. A line that is no order of it keeps its text in ``corrupt`` and has no other value; a field
    of another type makes its line corrupt.
    """
    reader = (spark.readStream if stream else spark.read).schema(f"{schemas.SOLD_ORDERS}, {_CORRUPT} string")
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    fields = [c for c in rows.columns if c != _CORRUPT]
    bad = F.col(_CORRUPT).isNotNull()
    return rows.select(*(F.when(~bad, F.col(c)).alias(c) for c in fields), F.col(_CORRUPT).alias("corrupt"))


def split_orders(orders: DataFrame) -> DataFrame:
    """One row a line of orders as ``read_orders`` gives them, with ``kind``: line, no_lines (an order without lines) or corrupt.

    Works on tables and streams alike; settlement takes the rows of kind line.
    """
    rows = orders.select("orderId", "creationDate", "corrupt", F.posexplode_outer("lineItems").alias("pos", "line"))
    kind = F.when(F.col("corrupt").isNotNull(), "corrupt").when(F.col("line").isNull(), "no_lines").otherwise("line")
    return rows.select(
        F.col("orderId").alias("order_id"), F.col("line.lineItemId").alias("line_id"), F.col("line.legacyItemId").alias("listing_id"), F.col("line.quantity").alias("quantity"),
        F.col("creationDate").alias("created"), "pos", kind.alias("kind"), "corrupt",
    )


def documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Form feeds become line ends and the text is trimmed; rejected_reason is set for texts under 20 characters."""
    clean = trim_all(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\f", "\n"))
    return df.withColumn(text, clean).withColumn("rejected_reason", F.when(F.char_length(text) < 20, "Document appears to be empty or image-only"))


def pages(df: DataFrame) -> DataFrame:
    """Fetched pages with the host of their URL in lower case."""
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return df.select("page_id", "url", host.alias("host"), "html")


def parse_responses(df: DataFrame, content: str = "content", key: str = "doc_id") -> DataFrame:
    """Supplied JSON responses as a struct ``response``; code fences are stripped, unparsable rows keep ``corrupt``."""
    unfenced = lambda c: F.when(F.contains(c, F.lit("```")), trim_all(F.regexp_replace(F.regexp_replace(c, r"^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(c)
    bare = let(trim_all(F.col(content)), unfenced)
    parsed = F.from_json(bare, schemas.RESPONSE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = let(parsed, lambda r: F.when(r["_corrupt"].isNull(), r.dropFields("_corrupt")))  # parsed once, not for each field
    rows = df.select(key, good.alias("response"), bare.alias("bare"))
    return rows.select(key, "response", F.when(F.col("response").isNull(), F.col("bare")).alias("corrupt"))


def response_items(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row an item of parsed responses, with its position."""
    return responses.where("response IS NOT NULL").select(key, F.posexplode("response.items").alias("item_pos", "i")).select(
        key, "item_pos", F.coalesce("i.partNumber", F.lit("")).alias("part_number"), F.coalesce("i.partName", F.lit("")).alias("part_name"),
        F.coalesce("i.quantity", F.lit(1.0)).alias("quantity"), F.col("i.unitPrice").alias("unit_price"), F.col("i.brand").alias("brand"),
    )


def search_results(df: DataFrame, content: str = "content") -> DataFrame:
    """Search responses (part_id, query_no, JSON) as one row a hit with its rank."""
    hits = F.from_json(content, schemas.SEARCH_RESPONSE)
    return df.select("part_id", "query_no", F.posexplode(hits["web"]["results"]).alias("rank", "hit")).select("part_id", "query_no", "rank", "hit.title", "hit.description", "hit.url")


def ocr_text(content: Column) -> Column:
    """The longer of markdown and joined page elements of an OCR response, cleaned; null under 20 characters."""
    r = F.from_json(content, schemas.OCR_RESPONSE)
    joined = F.array_join(F.transform(F.flatten(r["layout_details"]), lambda e: F.coalesce(e["content"], F.lit(""))), "\n")
    joined, marked = F.coalesce(joined, F.lit("")), F.coalesce(r["md_results"], F.lit(""))
    raw = F.when(marked != "", marked).otherwise(joined)
    best = F.when(F.char_length(joined) > F.char_length(raw), joined).otherwise(raw)
    return F.when(F.char_length(best) >= 20, clean_markup(best))


def supplement_text(docs: DataFrame, ocr_responses: DataFrame, quality: str = "quality_issue") -> DataFrame:
    """Documents (doc_id, text, quality issue) with their OCR text appended where the text is flagged."""
    joined = docs.join(ocr_responses.select("doc_id", F.col("content").alias("_ocr")), "doc_id", "left")
    joined = joined.withColumn("_ocr", F.when(F.col(quality).isNotNull(), ocr_text(F.col("_ocr"))))
    return joined.withColumn("text", F.when(F.col("_ocr").isNotNull(), F.concat("text", F.lit("\n\n--- OCR-enhanced text ---\n"), "_ocr")).otherwise(F.col("text"))).drop("_ocr")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target with those rows whose keys it does not hold; of rows with equal keys the least is taken."""
    order = [c for c in target.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_rest")).select(*keys, "_rest.*") if order else rows.dropDuplicates(keys)
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(*target.columns))
