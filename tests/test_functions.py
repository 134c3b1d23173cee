"""Column functions on small rows with known answers."""

import pytest
from pyspark.sql import functions as F

from partflow.functions import text as t


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("  wp-w.103 213-04  ", "WPW10321304"), ("#285753a", "285753A"), ("", ""), ("a-b.c d#e", "ABCDE")])
def test_normalize(spark, raw, want):
    assert one(spark, t.normalize_part_number(F.col("x")), x=raw) == want


@pytest.mark.parametrize("text, want", [("AP6872342 PS12711828 EA4514338 WPW10321304", ["WPW10321304"]), ("see WB62X10013 here", ["WB62X10013"]), ("12345678 and 1234567890123", ["12345678"])])
def test_mentions(spark, text, want):
    assert one(spark, t.mine_mentions(F.col("x")), x=text) == want


def test_part_numbers_overlap_and_keep_order(spark):
    assert one(spark, t.find_part_numbers(F.col("x")), x="dd81-12345678a then WP8544771, DC97-14486A wp8544771") == ["DD81-12345678A", "12345678A", "WP8544771", "DC97-14486A"]


def test_brand_needs_ascii_boundary(spark):
    assert one(spark, t.find_brand(F.col("x")), x="çge Samsung") == "ge"
    assert one(spark, t.find_brand(F.col("x")), x="garage") is None


def test_layouts(spark):
    assert one(spark, t.layout_type(F.col("x")), x="a\tb\tc\td\n1\t2\t3\t4") == "tab-delimited"
    assert one(spark, t.layout_type(F.col("x")), x="2 of: belt") == "n-of"
    assert one(spark, t.layout_type(F.col("x")), x="Qty   Name  Price") == "space-aligned"
    assert one(spark, t.layout_type(F.col("x")), x="nothing") == "labeled"


def test_redaction(spark):
    text = "Mail a.b@c.org call 555-123-4567 order 114-9176254-5449856 at 12 Main Street, card ending in 1234"
    assert one(spark, t.redact_text(F.col("x")), x=text) == "Mail [EMAIL] call [PHONE] order 114-9176254-5449856 at [ADDRESS], card ending in [XXXX]"


def test_rounding_and_numbers(spark):
    assert one(spark, t.round2(F.lit(1.005))) == 1.0
    assert one(spark, t.parse_qty(F.col("x")), x="3 pcs") == 3
    assert one(spark, t.parse_qty(F.col("x")), x="none") == 1
    assert one(spark, t.parse_price(F.col("x")), x="$1,299.00") == 1299.0
    assert one(spark, t.parse_price(F.col("x")), x="free") is None


@pytest.mark.parametrize("url, want", [("https://shop.example.com/a", True), ("http://shop.example.com", False), ("https://localhost/x", False), ("https://10.0.0.1/", False), ("https://[::1]/", False), ("https://a.internal/", False), (None, False)])
def test_urls(spark, url, want):
    assert one(spark, t.url_admissible(F.col("x")), x=url) is want


@pytest.mark.parametrize("ip, want", [("172.16.0.1", True), ("172.32.0.1", False), ("::ffff:10.1.1.1", True), ("100.64.0.1", True), ("8.8.8.8", False), ("fe80::1", True)])
def test_private(spark, ip, want):
    assert one(spark, t.is_private_ip(F.col("x")), x=ip) is want


def test_tracking(spark):
    assert one(spark, t.repair_tracking(F.col("a"), F.col("b")), a="12345678", b="x\n12345678\n 12 \n") == "1234567812"
    assert one(spark, t.valid_tracking(F.col("a"), F.col("b"), F.array(F.lit("9"))), a="1Z" + "A" * 16, b="N") == "1Z" + "A" * 16
    assert one(spark, t.valid_tracking(F.col("a"), F.col("b"), F.array(F.lit("1234567890"))), a="1234567890", b="N") is None


def test_literal_fraction(spark):
    assert one(spark, t.literal_fraction(F.col("x")), x=r"abc\d+") == 0.5


def test_nulls_stay_null(spark):
    for f in (t.normalize_part_number, t.clean_raw_number, t.find_brand, t.layout_type, t.clean_markup, t.redact_text, t.normalize_domain, t.round2, t.parse_price):
        one(spark, f(F.col("x")), x=None)


@pytest.mark.parametrize("text, want", [(" ﻿\t a b \r\n\x0b\f", "a b"), ("", ""), (" \n", ""), ("a \u0085", "a \u0085"), ("é ", "é")])
def test_trim_takes_no_space_before_another_mark(spark, text, want):
    """As the SQL trims: what stands at the very end decides, also behind a line end that the pattern of before passed over."""
    assert one(spark, t.trim_all(F.col("x")), x=text) == want
