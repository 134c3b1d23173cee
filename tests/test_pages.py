"""Selectors, fingerprints and extraction on order pages like those of shops."""

import json

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_oracle import rows

from partflow.operators import dom, pages
from partflow.plans import registry, rules

PAGE = """<html><head><style>.a{}</style></head><body><div class="order"><span class="no">Order # 114-9176254-5449856</span><span>Order placed April 5, 2026</span></div>
<div class="shipment box"><div class="shipment-inner"><a class="title">Whirlpool WP8544771 Dryer Heating Element</a><span class="price">$26.97</span><b class="qty">1</b></div></div>
<div class="shipment box"><div class="shipment-inner"><a class="title">Samsung DC97-14486A Door Boot Seal</a><span class="price">$21.97</span><b class="qty">2</b></div></div>
<p class="ship">$2.99</p><p class="tax">$6.93</p><input type="hidden" name="t" value="1"><script>var a = "<p>";</script></body></html>"""
CONFIG = {"itemContainer": ".box.shipment", "fields": {"partName": ".title", "quantity": ".qty", "unitPrice": ".price"}, "orderFields": {"orderNumber": ".order span:not(.x)", "orderDate": ".order span:not(.no)", "totalShipping": ".ship", "totalTax": ".tax"}}


def test_selectors():
    root = dom.parse(PAGE)
    assert len(dom.select(root, ".box.shipment")) == 2
    assert dom.select(root, ".order span:not(.no)")[0].text() == "Order placed April 5, 2026"
    assert len(dom.select(root, "[class*='inner'], input[type='hidden']")) == 3
    assert dom.parse(None).text() == ""


def test_extraction(spark):
    page = spark.createDataFrame([(1, PAGE, 5), (2, None, 5)], "page_id long, html string, preset_id long")
    orders, items = pages.extract_page_items(page, spark.createDataFrame([(5, json.dumps(CONFIG))], "id long, selectors string"))
    got = items.orderBy("item_pos").collect()
    assert [(r.part_number, r.brand, r.quantity, r.unit_price) for r in got] == [("WP8544771", "whirlpool", 1.0, 26.97), ("DC97-14486A", "samsung", 2.0, 21.97)]
    assert [r.ship_cost for r in got] == [1.14, 0.93]
    first = orders.where("doc_id = 1").first()
    assert (first.order_number, first.order_date, first.total_shipping, first.total_tax) == ("Order # 114-9176254-5449856", "Order placed April 5, 2026", 2.99, 6.93)


def test_fingerprint_ignores_texts_and_volatile_parts(spark):
    rows = [(1, "<main><h1>a</h1><div id='x'>1</div></main>"), (2, "<main><aside>ad</aside><h1>b</h1><div id='x'>2</div></main>"), (3, "<main><h1>a</h1><div id='y'>1</div></main>"), (4, "<main><h1>a</h1><div id='12345'>1</div></main>"), (5, "<main><h1>a</h1><div id='99999'>1</div></main>")]
    got = {r.page_id: r.page_fingerprint for r in pages.page_fingerprint(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]


def test_redaction_and_skeleton(spark):
    page = spark.createDataFrame([(1, PAGE.replace("April", "a@b.org April"))], "page_id long, html string")
    text = pages.redact_html(page).first().redacted
    assert "[EMAIL]" in text and "var a" not in text and "114-9176254-5449856" in text
    bare = pages.scrub_html(page).first().skeleton
    assert "hidden" not in bare and "script" not in bare and 'class="title"' in bare


def test_page_kinds(spark):
    rows = [("https://x.com/login", "<p>a</p>"), ("https://x.com", "Verify you are a human"), ("https://x.com", "<p>" + "word " * 60), ("https://x.com", '<div id="root"></div>' + "w" * 150), ("https://x.com", "<p>short</p>")]
    out = spark.createDataFrame(rows, "url string, html string").select(pages.classify_page(F.col("html"), F.col("url")).alias("k"))
    assert [r.k for r in out.collect()] == ["login", "captcha", "contentful", "contentful", "empty"]


def test_one_tree_for_all_readers(spark):
    rows = [(1, PAGE), (2, None), (3, "<body><nav>menu</nav><main><aside><p>x</p></aside><section id='s'><script>1</script>t</section></main></body>")]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r for r in pages.read_pages(frame).collect()}
    assert got[3].text.strip() == "xt" and got[3].structure == "section#s" and "aside" in got[3].skeleton and "script" not in got[3].skeleton
    assert (got[2].text, got[2].skeleton, got[2].structure) == ("", "", "")
    assert sum("MapInArrow" in line for line in pages.read_pages(frame)._jdf.queryExecution().executedPlan().toString().splitlines()) == 1


def test_import_from_gate_to_preset(spark):
    """Every fate of a page, counters of the preset, and selectors learnt only where they agree with valid supplied items."""
    shop, bare = PAGE, PAGE.replace('class="title"', 'class="name"')
    found = [
        (1, "https://www.shop.com/o/1", "8.8.8.8", shop), (2, "http://www.shop.com/o/2", "8.8.8.8", shop), (3, "https://other.org/", "8.8.8.8", shop), (4, "https://off.shop.org/", "8.8.8.8", shop),
        (5, "https://shop.com/o/5", "10.0.0.8", shop), (6, "https://shop.com/o/6", None, None), (7, "https://shop.com/signin?x", "8.8.8.8", shop), (8, "https://shop.com/o/8", "8.8.8.8", shop + "<!-- captcha -->"),
        (9, "https://shop.com/o/9", "8.8.8.8", bare), (10, "https://new.net/a", "8.8.8.8", shop), (11, "https://new.net/b", "8.8.8.8", shop), (12, "https://new.net/c", "8.8.8.8", shop),
    ]
    frame = spark.createDataFrame(found, "page_id long, url string, address string, html string")
    key = pages.page_fingerprint(frame.where("page_id = 1")).first().page_fingerprint
    names = "id long, vendor_key string, input_type string, page_fingerprint string, selectors string, sample_snippet string, success_count int, fail_count int, last_used_at timestamp_ntz"
    presets = spark.createDataFrame([(4, "shop.com", "html", key, json.dumps(CONFIG), "old", 3, 2, None), (9, "new.net", "html", key, json.dumps(CONFIG), "old", 0, 3, None)], names)
    domains = spark.createDataFrame([(1, "shop.com", "new"), (2, "new.net", "new"), (3, "shop.org", "unconfigured")], "id long, domain string, status string")
    good = [("WP8544771", "Whirlpool WP8544771 Dryer Heating Element", 1.0, 26.97), ("DC97-14486A", "Samsung DC97-14486A Door Boot Seal", 2.0, 21.97)]
    supplied = [(p, i, *item) for p in (9, 10, 11) for i, item in enumerate(good)]
    supplied = [(*r[:5], r[5] + 5 * (r[0] == 11)) for r in supplied] + [(12, 0, "", "", 0.0, -1.0)]
    candidates = spark.createDataFrame([(9, json.dumps(CONFIG)), (10, json.dumps(CONFIG)), (11, json.dumps(CONFIG))], "page_id long, selectors string")
    out = pages.import_pages(frame, presets, domains, spark.createDataFrame(supplied, "doc_id long, item_pos int, part_number string, part_name string, quantity double, unit_price double"), candidates, F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.page_id: (r.outcome, r.source, r.item_count) for r in out.results.collect()}
    assert got == {
        1: ("ok", "preset", 2), 2: ("validation", None, None), 3: ("no_cookies", None, None), 4: ("no_cookies", None, None), 5: ("error", None, None), 6: ("error", None, None), 7: ("login", None, None), 8: ("captcha", None, None),
        9: ("ok", "llm", 2), 10: ("ok", "llm", 2), 11: ("ok", "llm", 2), 12: ("ok", "empty", 0),
    }
    after = {r.id: (r.vendor_key, r.success_count, r.fail_count, r.sample_snippet == "old") for r in out.presets.collect()}
    assert after == {4: ("shop.com", 4, 1, True), 9: ("new.net", 1, 0, False)}  # the candidate of page 9 finds no names, that of page 11 other prices
    assert {r.domain: r.status for r in out.domains.collect()} == {"shop.com": "active", "new.net": "active", "shop.org": "unconfigured"}
    items = out.items.collect()
    assert len(items) == 8 and {(r.doc_id, r.ship_cost) for r in items if r.doc_id == 1} == {(1, 1.14), (1, 0.93)}
    assert "[EMAIL]" not in out.results.where("page_id = 12").first().raw_text and "Order # 114-9176254-5449856" in out.results.where("page_id = 12").first().raw_text


@pytest.mark.parametrize("name", ["s11_redact_html", "s12_scrub_html", "ud2_extract_page_items"])
def test_cut_references_and_long_numbers_match_sql(spark, tmp_path, name):
    """Titles cut inside a character reference, and prices of more digits than a 64-bit number has."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW given AS SELECT *, list_extract(['&amp', '&am', '&', '&lt', '&gt', '&quot', '&quo', ''], CAST(page_id % 8 + 1 AS INTEGER)) AS tail FROM '{DATA}/pages.parquet'")
    con.execute("CREATE TABLE pages AS SELECT * EXCLUDE (tail) REPLACE (replace(replace(regexp_replace(html, '<p>', '<p>$' || repeat('9', CAST(page_id % 40 AS INTEGER)) || ' '), '</title>', tail || '</title>'), '</h1>', tail || '</h1>') AS html) FROM given")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    frame, found = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert rows(frame.columns, frame.collect()) == rows(names, found.fetchall())


def _dealt(spark, monkeypatch, run):
    """Into how many tasks the pages of ``run`` come where their selectors are applied, without help from adaptive plans or broadcasts."""
    counts, cells = [], pages.page_cells
    monkeypatch.setattr(pages, "page_cells", lambda source: counts.append(source.select(F.spark_partition_id().alias("p")).distinct().count()) or cells(source))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return counts


@pytest.mark.parametrize("name", ["ud2_extract_page_items", "page_chain", "pipe5_selector_acceptance"])
def test_pages_of_one_preset_are_read_by_many_tasks(spark, data, monkeypatch, name):
    """All pages of the table have one structure, and so one preset."""
    import __spark_entry__ as entry

    def chain(spark, path):
        found = spark.read.parquet(f"{path}/pages.parquet")
        presets = pages.page_fingerprint(found).select("page_fingerprint").distinct().selectExpr("1L AS id", "'v' AS vendor_key", "'html' AS input_type", "page_fingerprint", f"'{rules.SELECTORS}' AS selectors", "0 AS fail_count")
        none = spark.createDataFrame([], "doc_id long, item_pos int, part_number string, part_name string, quantity double, unit_price double")
        return pages.page_chain(found, presets, none, F.lit("v"))

    run = chain if name == "page_chain" else entry.queries()[name]
    counts = _dealt(spark, monkeypatch, lambda: run(spark, data))
    assert counts and min(counts) > 1


def test_import_deals_html_by_page_alone(spark, data, monkeypatch):
    """All pages of the table have one structure; neither their host nor their preset says which task reads them."""
    import __spark_entry__ as entry

    made, read = [], pages.read_pages
    monkeypatch.setattr(pages, "read_pages", lambda source, *a: made.append(source) or read(source, *a))
    counts = _dealt(spark, monkeypatch, lambda: entry.queries()["pipe2_import_pages"](spark, data))
    assert counts and min(counts) > 1
    source = made[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "html" in source and not any("Join" in line and "host" in line for line in source.splitlines())


@pytest.mark.parametrize("selectors", [("p, li",), ("a:not(.x)", "[id*='d-']"), ("*",), ("nav li a", ".x, #y", "LI"), (":not(p)",), ("[role='main'] p", "aside")])
def test_selectors_in_one_walk(selectors):
    html = "<nav><ul><li class='x'><a>1</a><li><a class='x'>2</a></ul></nav><div role='main' id='ad-1'><p>3<p id='y'>4</div><aside>5</aside>"
    root = dom.parse(html)
    every = [n for n in root.walk() if any(dom._matches(n, dom._compiled(s)) for s in selectors)]
    assert every and list(dom._found(root, selectors)) == every and dom.marked(root, *selectors) == {id(n) for n in every}
