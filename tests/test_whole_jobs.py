"""Queries that read all their rows, against brute force in Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from partflow.functions import text as t
from partflow.operators import extraction
from partflow.plans import routing, rules, streams
from partflow.sources import tables


def _numbers(text):
    found = {}
    for shape in t.PART_NUMBER_FORMATS:
        for m in re.finditer(rf"\b({shape})\b", text, re.I | re.A):
            found.setdefault(m[1].upper(), m.start())
    return sorted(found, key=found.get)


def test_part_numbers_of_all_documents(spark, data, tmp_path):
    texts = [
        "order WP8544771 and dc97-14486a, again wp8544771", "WPW10321304 AP6872342\nPS12711828 EAP4514338 AH1234567", "WR55X10942 WB62X10013 WH12X10468 WE11X10018 DE81X0512",
        "DD81-01629A W10130694 285753AB", "room W3, 123456 a, xWP8544771", "no number", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = spark.read.parquet(f"{data}/part.parquet").where("p_partkey >= 100")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    rows = entry.queries()["s3_find_part_numbers"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + parts.count()
    got = {r.id: r.numbers for r in rows if r.id < len(texts)}
    assert got == {i: None if x is None else _numbers(x) for i, x in enumerate(texts)}
    assert sum(len(x or []) for x in got.values()) == 15


def test_items_of_all_routes(spark, data):
    made = entry.queries()["pipe1_all_items"](spark, data).cache()
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    assert made.count() == lines.count() > entry.queries()["pipe1_items"](spark, data).count()
    routes = entry.queries()["pipe1_routes"](spark, data)
    assert {r.route for r in made.select("route").distinct().collect()} == {r.route for r in routes.select("route").distinct().collect()} > {"template"}
    assert made.where("ship_cost IS NULL OR tax_price IS NULL OR order_number != concat('N', doc_id) OR brand = 'kit' OR delivery_courier = 'paid'").count() == 0


def test_extraction_by_supplied_responses(spark):
    text = "Tax: 2.00\nShipping: 4.00\nTracking 1234567890\n12\nend"
    docs = spark.createDataFrame([(1, text, None, None), (2, text, None, None)], "doc_id long, text string, template_id long, confidence string")
    content = '{"orderNumber":"A","trackingNumber":"1234567890","deliveryCourier":"Paid","items":[{"partNumber":"P1","quantity":2,"unitPrice":5,"brand":"kit"},{"partNumber":"P2","quantity":1,"unitPrice":10,"brand":"lg"}]}'
    responses = tables.parse_responses(spark.createDataFrame([(1, content)], "doc_id long, content string"))
    templates = rules.templates(spark, "/root/testdata/sf0.001")
    for mode in ("template", "llm"):
        routes, metadata, items = routing.extract_documents(docs, templates, F.lit(rules.NOW).cast("timestamp_ntz"), responses, mode)
        assert routes.count() == 2
        assert [tuple(r) for r in items.orderBy("item_pos").select("doc_id", "part_number", "ship_cost", "tax_price", "brand").collect()] == [(1, "P1", 1.0, 0.5, None), (1, "P2", 2.0, 1.0, "lg")]
        got = {r.doc_id: (r.order_number, r.tracking_number, r.delivery_courier) for r in metadata.collect()}
        assert got == {1: ("A", "123456789012", None), 2: (None, None, None)}


def test_spot_checks_fail_templates(spark, data):
    before = {r.id: (r.success_count, r.fail_count) for r in rules.templates(spark, data).collect()}
    routes = [r for r in entry.queries()["pipe1_routes"](spark, data).collect() if r.route == "template"]
    want = {i: list(n) for i, n in before.items()}
    for r in sorted(routes, key=lambda r: r.doc_id):
        want[r.template_id][0] += 1
        if want[r.template_id][0] % 10 == 0 and r.doc_id % 7 == 0:
            want[r.template_id][1] += 1
    got = {r.id: [r.success_count, r.fail_count] for r in entry.queries()["pipe6_spot_check_counters"](spark, data).collect()}
    assert got == want and sum(f for _, f in got.values()) > sum(f for _, f in before.values())


def test_selectors_are_refused(spark, data):
    got = {r.doc_id: r.agrees for r in entry.queries()["pipe5_selector_acceptance"](spark, data).collect()}
    assert {i % 3 for i, agrees in got.items() if agrees} == {2} and not any(agrees for i, agrees in got.items() if i % 3 < 2)


def test_rules_that_do_not_compile_stop_nothing(spark):
    rule = lambda start, end, row: json.dumps({"lineItems": {"start": start, "end": end, "row": row}})
    row = r"(?<partNumber>P\d+) (?<quantity>\d+) (?<unitPrice>[\d.]+)"
    made = spark.createDataFrame([(1, rule("", "", "(P")), (2, rule("[", "", row)), (3, rule("", "*", row)), (4, rule("Items", "End", row)), (5, None)], "id long, extraction_rules string")
    text = "P9 1 9.5\nItems\nP1 2 3.50\nP2 1 4 payment\nP3 0 1\nEnd P4 1 1"
    docs = spark.createDataFrame([(i, text, i) for i in range(1, 7)], "doc_id long, text string, template_id long")
    got = {}
    for r in extraction.extract_items(docs, extraction.parse_rules(made)).orderBy("doc_id", "item_pos").collect():
        got.setdefault(r.doc_id, []).append((r.item_pos, r.part_number, r.quantity, r.unit_price))
    whole = [(0, "P9", 1.0, 9.5), (1, "P1", 2.0, 3.5), (2, "P2", 1.0, 4.0), (3, "P3", 1.0, 1.0), (4, "P4", 1.0, 1.0)]
    assert got == {2: whole, 3: whole, 4: [(0, "P1", 2.0, 3.5), (1, "P2", 1.0, 4.0), (2, "P3", 1.0, 1.0)]}
    assert {r.id: r.row_compiles for r in extraction.check_rules(extraction.parse_rules(made)).collect()}[1] is False


def test_whole_documents(spark, data):
    made = entry.queries()["pipe1_documents"](spark, data).cache()
    n = spark.read.parquet(f"{data}/documents.parquet").count() + spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert made.count() == n == made.select("doc_id").distinct().count()
    short = made.where("rejected_reason IS NOT NULL")
    assert short.where("route IS NOT NULL OR n_items > 0").count() == 0
    # The texts of invoices name the domain of vendor doc_id % 3 beside a keyword: the domain goes first, and of its templates the first.
    assert made.where("doc_id >= 0 AND (template_id != doc_id % 3 OR confidence != 'domain')").count() == 0
    assert made.where("route = 'template' AND (outcome != true OR n_items = 0 OR ship_cost <= 0 OR order_number != concat('N', doc_id))").count() == 0
    assert {"template", "fallback-new"} <= {r.route for r in made.select("route").distinct().collect()}
    flagged = made.where("doc_id < 0 AND quality_issue IS NOT NULL")  # their OCR text names a domain
    assert flagged.count() > 0 and flagged.where("confidence IS NULL OR confidence != 'domain' OR template_id != abs(doc_id) % 9").count() == 0


def test_whole_documents_read_texts_once(spark):
    """Raw texts are read once for good and rejected documents, and only texts of poor quality meet their OCR text."""
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    soup = "\n".join(["ab", "a longer line"] * 6)
    raw = spark.createDataFrame([(1, "short"), (2, "an invoice of twenty characters, sold by Vendor1"), (3, soup)], "doc_id long, text string")
    ocr = spark.createDataFrame([(i, json.dumps({"md_results": "read again by https://www.parts2.com"})) for i in (1, 2, 3)], "doc_id long, content string")
    known = spark.createDataFrame(
        [(i, f"v{i}", f"V{i}", [f"PARTS{i}.com"], [f"Vendor{i}"], "{}", 0, 0, None) for i in (1, 2)],
        "id long, vendor_key string, vendor_name string, vendor_domains array<string>, vendor_keywords array<string>, extraction_rules string, success_count int, fail_count int, last_generation_attempt timestamp_ntz",
    )
    replies = tables.parse_responses(spark.createDataFrame([(2, '{"orderNumber": "N2"}'), (3, "no json")], "doc_id long, content string"))
    made = routing.parse_documents(raw.mapInArrow(counted, raw.schema), known, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), replies, ocr)
    got = {r.doc_id: (r.template_id, r.confidence, r.quality_issue, r.rejected_reason is None, r.order_number) for r in made.collect()}
    assert got == {1: (None, None, None, False, None), 2: (1, "keyword", None, True, "N2"), 3: (2, "domain", "fragment-soup", True, None)}
    assert met.value == 3


def test_documents_are_extracted_once_for_all_results(spark, data, capsys):
    """Items, metadata and routes are read from what one extraction has written; none of them reads a text again."""
    entry.queries()["pipe1_all_items"](spark, data).explain()
    plan = capsys.readouterr().out
    assert "regexp_extract" not in plan and "from_json" not in plan and "lineitem" not in plan


def test_spot_checks_and_comparisons_read_once(spark, data, capsys):
    """Counters come from documents whose items are written down once, and a comparison runs either side once."""
    entry.queries()["pipe6_spot_check_counters"](spark, data).explain()
    assert "regexp_extract" not in capsys.readouterr().out
    item = lambda n, price: spark.range(n).selectExpr("id % 2 AS doc_id", "cast(id AS int) AS item_pos", "concat('P', id div 4) AS part_number", f"{price} AS unit_price")
    ours, theirs = item(6, "id / 2"), item(9, "if(id < 4, 0.5D, NULL)")
    made = extraction.compare_extractions(ours, theirs)
    made.explain()
    assert capsys.readouterr().out.count("Range (") == 2
    assert {r.doc_id: r.reason for r in made.collect()} == {0: "Template extracted 3 items, supplied 5", 1: "Template extracted 3 items, supplied 4"}
    assert {r.doc_id: r.reason for r in extraction.compare_extractions(item(9, "id / 2"), theirs).collect()} == {0: "Price mismatch for P0", 1: None}
    assert {r.doc_id: r.reason for r in extraction.compare_extractions(item(8, "0.5D"), theirs.where("item_pos > 0 AND item_pos < 8").withColumn("part_number", F.expr("if(item_pos = 6, 'X', part_number)"))).collect()} == {0: "Template missing part number: X", 1: None}


def test_labels_are_dealt_to_many_tasks(spark, data):
    """All parts come in one small file, which one task would read and search."""
    from partflow.plans import texts

    made = texts._labels(spark, data)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert made.count() == made.select("id").distinct().count() == spark.read.parquet(f"{data}/part.parquet").count()


@pytest.mark.parametrize("name", ["snk1_ledger", "snk2_stored_parts"])
def test_polls_fetch_lines_once(spark, data, monkeypatch, name):
    """Sold lines meet their orders once for a poll and its repeat."""
    met, sold = spark.sparkContext.accumulator(0), streams._sold

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    def once(spark, path):
        lines = sold(spark, path)
        return lines.mapInArrow(counted, lines.schema)

    monkeypatch.setattr(streams, "_sold", once)
    assert entry.queries()[name](spark, data).count() > 0
    assert met.value == sold(spark, data).count()
