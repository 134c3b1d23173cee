"""Folds against plain loops, ledger sums, replays and pages on hand-made rows."""

import random
import re
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from partflow.operators import catalog, crossref, inventory, settlement, vendors
from partflow.operators.numbering import numbered
from partflow.sources import schemas, tables
from partflow.sources.tables import insert_absent

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PARTS = "id long, part_number string, part_number_raw string, brand string, description string, quantity int, listed_quantity int, ebay_listing_id string"
PROCESSED = "order_id string, line_id string, part_id long, quantity_depleted int, quarantine_reason string"


@FEW
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9)), max_size=25))
def test_deplete_is_a_fold(spark, asked):
    parts = spark.createDataFrame([(i, f"P{i}", "p", None, None, 10, i, None) for i in (1, 2)], PARTS)
    requests = spark.createDataFrame([(n, p, q, "used", None) for n, (p, q) in enumerate(asked)], "seq long, part_id long, quantity int, reason string, note string")
    stock, ok, bad = {1: 10, 2: 10}, [], []
    for n, (p, q) in enumerate(asked):
        if p in stock and q <= stock[p] - p:
            stock[p] -= q
            ok.append((n, p, -q))
        else:
            bad.append(n)
    state, events, rejects = inventory.deplete_parts(parts, requests)
    assert {r.id: r.quantity for r in state.collect()} == stock
    assert sorted((r.seq, r.part_id, r.quantity_change) for r in events.collect()) == ok
    assert sorted(r.seq for r in rejects.collect()) == bad


def sale(n, order, line, listing, quantity):
    return (order, line, listing, quantity, datetime(2024, 1, 1, 0, n))


LINES = "order_id string, line_id string, listing_id string, quantity int, created timestamp"


@FEW
@given(st.lists(st.tuples(st.sampled_from(["L1", "L2", "L9"]), st.integers(1, 3), st.integers(0, 5)), max_size=20))
def test_settle_is_a_fold(spark, sales):
    parts = spark.createDataFrame([(1, "P1", "p", None, None, 6, 5, "L1"), (2, "P2", "p", None, None, 4, 3, "L2")], PARTS)
    lines = spark.createDataFrame([sale(n, str(o), "1", x, q) for n, (x, q, o) in enumerate(sales)], LINES)
    stock, seen, want = {"L1": [6, 5], "L2": [4, 3]}, set(), []
    for n, (x, q, o) in enumerate(sales):
        if o in seen:
            want.append("skipped")
            continue
        seen.add(o)
        if x in stock and stock[x][0] >= q and stock[x][1] >= q:
            stock[x] = [stock[x][0] - q, stock[x][1] - q]
            if stock[x][1] == 0:
                del stock[x]
            want.append("processed")
        else:
            want.append("quarantined")
    verdicts = settlement.settle(parts, lines, spark.createDataFrame([], PROCESSED))
    assert [r.status for r in verdicts.orderBy("created").collect()] == want
    again = settlement.settle(settlement.settled_parts(parts, verdicts), lines, settlement.processed_after(spark.createDataFrame([], PROCESSED), verdicts))
    assert {r.status for r in again.collect()} <= {"skipped"}


def test_settle_known_case(spark):
    parts = spark.createDataFrame([(1, "P1", "p", None, None, 4, 3, "L1")], PARTS)
    lines = spark.createDataFrame([sale(n, str(n), "1", "L1", q) for n, q in enumerate((2, 5, 1, 1))], LINES)
    out = settlement.settle(parts, lines, spark.createDataFrame([], PROCESSED)).orderBy("created").collect()
    assert [r.status for r in out] == ["processed", "quarantined", "processed", "quarantined"]
    assert out[1].quarantine_reason == "Invariant violation: quantity=2, listedQuantity=1, sold=5"
    assert out[3].quarantine_reason == "No matching listing for eBay item L1"


def test_settle_computes_its_lines_once(spark):
    """Counts of listings and all kinds of verdicts come from lines that are written down once with their mark."""
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    parts = spark.createDataFrame([(1, "P1", "p", None, None, 4, 3, "L1")], PARTS)
    lines = spark.createDataFrame([sale(n, str(n % 9), "1", f"L{n % 3}", 1) for n in range(12)], LINES).mapInArrow(counted, LINES)
    out = settlement.settle(parts, lines, spark.createDataFrame([("8", "1", None, 0, None)], PROCESSED)).collect()
    assert sorted(r.status for r in out) == ["processed"] * 3 + ["quarantined"] * 5 + ["skipped"] * 4
    assert met.value == 12


def test_intake_adds_up_and_ledger_agrees(spark):
    parts = spark.createDataFrame([(7, "A1", "a-1", "old", "d", 2, 0, None)], PARTS)
    adds = spark.createDataFrame([(1, "#a.1", None, None, 3, None), (2, "B 2", "x", None, 1, None), (3, "b2", None, "new", 4, None)], "seq long, part_number string, brand string, description string, quantity int, note string")
    state, events = inventory.add_parts(parts, adds)
    got = {r.part_number: r for r in state.collect()}
    assert (got["A1"].quantity, got["A1"].brand, got["B2"].quantity, got["B2"].part_number_raw, got["B2"].brand, got["B2"].description, got["B2"].id) == (5, "old", 5, "B 2", "x", "new", 8)
    assert {r.part_id: r.n for r in events.groupBy("part_id").agg(F.sum("quantity_change").alias("n")).collect()} == {7: 3, 8: 5}


def patched(rows, parts):
    """The same by a plain loop: states after all patches, and rejects."""
    states, bad = {p[0]: dict(brand=p[1], description=p[2], ebay_listing_id=p[3], listed_quantity=p[4]) for p in parts}, []
    stock = {p[0]: p[5] for p in parts}
    for seq, part, patch in rows:
        new = {**states[part], **patch} if part in states else None
        if new is not None and new["listed_quantity"] is None:
            new["listed_quantity"] = states[part]["listed_quantity"]
        if new is None:
            bad.append((seq, part, "Part not found"))
        elif not 0 <= new["listed_quantity"] <= stock[part]:
            bad.append((seq, part, f"listed_quantity must be between 0 and {stock[part]}"))
        elif new["listed_quantity"] > 0 and not new["ebay_listing_id"]:
            bad.append((seq, part, "ebay_listing_id required when listed_quantity > 0"))
        elif new["listed_quantity"] == 0 and new["ebay_listing_id"]:
            bad.append((seq, part, "ebay_listing_id must be null when listed_quantity is 0"))
        else:
            states[part] = new
    return states, sorted(bad)


def test_patches_are_one_running_state(spark):
    """A part with nearly all patches, over several batches, against a plain loop."""
    rng = random.Random(8)
    parts = [(1, "b", "d", "L1", 2, 5), (2, None, None, None, 0, 3)]
    values = {"brand": ["x", "y", None], "description": ["long", None], "ebay_listing_id": ["L8", "L9", None], "listed_quantity": [0, 1, 4, 6, -1, None]}
    rows = [(i, rng.choice([1] * 40 + [2, 3]), {c: rng.choice(v) for c, v in values.items() if rng.random() < 0.4}) for i in range(25_000)]
    frame = spark.createDataFrame([(i, f"P{i}", *rest) for i, *rest in parts], "id long, part_number string, brand string, description string, ebay_listing_id string, listed_quantity int, quantity int")
    asked = spark.createDataFrame([(i, p, *(x.get(c) for c in inventory.PATCHED), *(c in x for c in inventory.PATCHED)) for i, p, x in rows], "seq long, part_id long, brand string, description string, ebay_listing_id string, listed_quantity int, has_brand boolean, has_description boolean, has_ebay_listing_id boolean, has_listed_quantity boolean")
    state, rejects = inventory.update_parts(frame, asked.repartition(5))
    states, bad = patched(rows, parts)
    assert {r.id: {c: r[c] for c in inventory.PATCHED} for r in state.collect()} == states
    assert sorted(map(tuple, rejects.collect())) == bad


def test_alternatives_rules(spark):
    parts = spark.createDataFrame([(1, "A", "a", None, None, 1, 0, None), (2, "B", "b", None, None, 0, 0, None), (3, "C", "c", None, None, 5, 1, None), (4, "D", "d", None, None, 2, 0, None)], PARTS)
    refs = spark.createDataFrame([(1, "b", "replaces", "u"), (1, "C", "replaces", "u"), (2, "A", "compatible", "u"), (4, "A", "replaced_by", "u")], "part_id long, cross_ref_part_number string, relationship string, source_url string")
    out = catalog.alternatives(spark.createDataFrame([("A",), ("Z",)], "part_number string"), parts, refs).collect()
    assert sorted((r.alternative, r.side, r.available) for r in out) == [("C", "forward", 4), ("D", "reverse", 2)]


def test_fuzzy_search(spark):
    parts = spark.createDataFrame([(1, "WPW10321304"), (2, "WPW10321305"), (3, "DC9714486A"), (4, "X1")], "id long, part_number string")
    asked = spark.createDataFrame([("wp-w10321304",), ("9714",), ("x",)], "request string")
    got = {(r.request, r.id) for r in catalog.search_fuzzy(asked, parts).collect()}
    assert {("wp-w10321304", 1), ("wp-w10321304", 2), ("9714", 3), ("x", 4)} <= got and ("9714", 1) not in got


def test_fuzzy_search_broadcasts_no_postings(spark):
    """Few requests of many rows: parts look smaller than they are, their postings must still not pass through the driver."""
    parts = spark.range(20_000).selectExpr("id", "concat('WP', lpad(id, 8, '0')) AS part_number")
    asked = spark.range(100_000).selectExpr("concat('wp000', id % 10 * 70) AS request")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")  # room for one page of a small table, not for postings
    try:
        assert catalog.search_fuzzy(asked, parts).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_longest_domain_wins(spark):
    hosts = spark.createDataFrame([("signin.identity.ebay.com",), ("notamazon.com",), ("www.amazon.com",)], "host string")
    domains = spark.createDataFrame([("ebay.com",), ("identity.ebay.com",), ("amazon.com",)], "domain string")
    assert {r.host: r.domain for r in vendors.match_domain(hosts, domains).collect()} == {"signin.identity.ebay.com": "identity.ebay.com", "www.amazon.com": "amazon.com"}


def test_validation_reasons(spark):
    rows = spark.createDataFrame([("x" * 51, None, None, 1, None), ("ok", None, None, None, None), ("ok", None, None, 0, "n" * 1001)], "part_number string, brand string, description string, quantity int, note string")
    valid, rejected = inventory.validate_rows(rows, "add_part")
    assert [r.quantity for r in valid.collect()] == [1]
    assert sorted(r.reasons for r in rejected.collect()) == [["part_number"], ["quantity", "note"]]


def test_insert_absent(spark):
    both = insert_absent(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "c")]


def test_stock_tables_are_loaded_with_their_schemas(spark, tmp_path):
    for name, schema in schemas.STOCK_TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}")
    found = tables.load(spark, f"file://{tmp_path}")
    assert set(found) == set(schemas.STOCK_TABLES) and all(f.count() == 0 for f in found.values())


def test_positions_over_blocks(spark):
    rows = [(i * i % 97, f"t{i}") for i in range(300)] + [(5, "same")] * 3
    for blocks in (1, 7, 256):
        got = numbered(spark.createDataFrame(rows, "seq long, name string"), "seq", "name", blocks).collect()
        assert [(r.seq, r.name) for r in sorted(got, key=lambda r: r.position)] == sorted(rows) and sorted(r.position for r in got) == list(range(1, 304))
    assert numbered(spark.createDataFrame([], "seq long, name string"), "seq", "name").count() == 0


def test_poll_needs_a_watermark(spark):
    lines = spark.createDataFrame([sale(1, "1", "1", "L1", 1)], LINES)
    with pytest.raises(Exception, match="not initialised"):
        settlement.poll_window(lines, spark.createDataFrame([], "last_polled_at timestamp_ntz"), F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")).count()


@pytest.mark.parametrize("room, sizes", [(8000, lambda i: (i * 7) % 5 + 1), (300, lambda i: 1 + (i * i) % 97), (50, lambda i: 60 if i < 4000 else 3 - i % 2), (10**6, lambda i: 5), (0, lambda i: 1), (500, lambda i: -1 if i == 900 else 2), (700, lambda i: None if i % 3 else i % 11)])
def test_hot_keys_are_folded_in_blocks(spark, room, sizes):
    """A listing, or a part, with most of all rows: its blocks are folded side by side, with the rows of a plain loop."""
    asked = [sizes(i) for i in range(9000)]
    rng = random.Random(3)
    order = list(range(9000))
    rng.shuffle(order)
    parts = spark.createDataFrame([(1, "P1", "p", None, None, room + 3, room, "L1"), (2, "P2", "q", None, None, 40, 30, "L2")], PARTS)
    lines = spark.createDataFrame([sale(0, f"{i:06d}", "1", "L1", asked[i]) for i in order] + [sale(1, f"x{i}", "1", "L2", 2) for i in range(30)], LINES).repartition(5)
    running, want = (room + 3, room, True), []
    for n in asked:
        status, reason, running = settlement.judge("L1", n, running)
        want.append((status, reason))
    got = settlement.settle(parts, lines, spark.createDataFrame([], PROCESSED), hot_rows=1000)
    assert [(r.status, r.quarantine_reason) for r in got.where("listing_id = 'L1'").orderBy("order_id").collect()] == want
    assert got.where("listing_id = 'L2' AND status = 'processed'").count() == 15

    if any(n is not None and n < 0 for n in asked):
        return  # no withdrawal asks for less than nothing
    left, ok, free = room, [], []
    for i, n in enumerate(asked):
        free.append(left)
        if n is not None and n <= left:
            left -= n
            ok.append(i)
    requests = spark.createDataFrame([(i, 1, asked[i], "used", None) for i in order], "seq long, part_id long, quantity int, reason string, note string").repartition(5)
    plain = spark.createDataFrame([(1, "P1", "p", None, None, room + 3, 3, None)], PARTS)
    state, events, rejects = inventory.deplete_parts(plain, requests, hot_rows=1000)
    assert sorted(r.seq for r in events.collect()) == ok and state.first().quantity == left + 3
    assert all(r.message is None or f"only {free[r.seq]} available" in r.message for r in rejects.collect())


def test_hot_listing_is_one_running_stock(spark):
    """Many lines of one listing over several batches against a plain loop."""
    parts = spark.createDataFrame([(1, "P1", "p", None, None, 9000, 8000, "L1")], PARTS)
    sizes = [(i * 7) % 5 + 1 for i in range(25_000)]
    lines = spark.createDataFrame([sale(0, f"{i:06d}", "1", "L1", q) for i, q in enumerate(sizes)], LINES)
    left, sold = 8000, 0
    for q in sizes:
        if left and q <= left:
            left, sold = left - q, sold + 1
    got = settlement.settle(parts, lines, spark.createDataFrame([], PROCESSED)).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"processed": sold, "quarantined": 25_000 - sold}


KNOWN = [(3, [], ["Acme Tools", "abc"]), (1, [], ["a&b parts"]), (2, ["x.com"], ["&&&&"]), (4, [], ["tools!", "Größe"])]
TEXTS = ["sold by ACME tools!", "acme  tools", "xacme tools", "from A&B Parts Ltd", "see https://www.X.com now, acme tools", "abc", None, "a&&&&b", "größe", "", "die GRößE x", "acme tools and a&b parts"]


@pytest.mark.parametrize("shard_chars", [1 << 20, 5])
def test_keywords_are_whole_words(spark, shard_chars):
    made = spark.createDataFrame(KNOWN, "id long, vendor_domains array<string>, vendor_keywords array<string>")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.template_id, r.confidence) for r in vendors.detect_vendor(docs, made, shard_chars).collect()}
    want = {4: (2, "domain")}
    for i, text in enumerate(TEXTS):
        edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
        hits = [t for t, _, words in KNOWN for w in words if len(w) >= 4 and re.search(f"(?ai){edge}{re.escape(w.lower())}{edge}", text or "")]
        if hits and i not in want:
            want[i] = (min(hits), "keyword")
    assert got == want and want[0] == (3, "keyword") and want[7] == (2, "keyword")


def test_many_keywords_in_one_pass(spark):
    words = [f"vendor {i} inc" for i in range(100_000)]
    made = spark.range(100_000).selectExpr("id", "CAST(array() AS array<string>) AS vendor_domains", "array(concat('Vendor ', id, ' Inc')) AS vendor_keywords")
    docs = spark.createDataFrame([(i, f"x {words[i * 37]}, {words[i * 11]} y") for i in range(2000)], "doc_id long, text string")
    assert {r.doc_id: r.template_id for r in vendors.detect_vendor(docs, made).collect()} == {i: i * 11 for i in range(2000)}


def test_domains_in_texts(spark):
    """Domains are read from where a name begins or the last one ended; a word of any length is read once."""
    made = spark.createDataFrame([(i, [d], []) for i, d in enumerate(["foo.com", "1bar.org", "www.com", "xwww.foo", "a-b.net"])], "id long, vendor_domains array<string>, vendor_keywords array<string>")
    texts = ["see HTTPS://www.Foo.com", "foo.com1bar.org", "xfoo.co 1bar.org", "www.com", "xwww.foo.com", "xhttp://a-b.net/", "foo. com .org", "w" * 300_000 + " at foo.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.template_id for r in vendors.detect_vendor(docs, made).collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 7: 0}


def _plan(made, spark, capsys):
    """The plan of a query whose tables are all too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made().explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return capsys.readouterr().out


def test_hits_are_sorted_once(spark, capsys):
    """Search hits are dealt by part once, and sorted only to be counted."""
    hits = spark.range(5).selectExpr("id AS part_id", "1L AS query_no", "id AS rank", "'t' AS title", "'fits WP12345678' AS description", "'u' AS url")
    parts = spark.range(5).selectExpr("id", "'WP1' AS part_number", "'wp1' AS part_number_raw")
    plan = _plan(lambda: crossref.mine_cross_refs(hits, parts), spark, capsys)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 1


def test_references_meet_parts_without_sorting(spark, capsys):
    """Only the two sides of alternatives are sorted to meet; references meet parts by hashing."""
    parts = spark.range(5).selectExpr("id", "concat('P', id) AS part_number", "1 AS quantity", "0 AS listed_quantity")
    refs = spark.range(5).selectExpr("id AS part_id", "'p1' AS cross_ref_part_number", "'replaces' AS relationship")
    plan = _plan(lambda: catalog.alternatives(parts.select("part_number"), parts, refs), spark, capsys)
    assert plan.count("ShuffledHashJoin") >= 2 and plan.count("SortMergeJoin") <= 2


def test_requests_are_sorted_apart(spark, capsys):
    """Requests are dealt by number before they are sorted to be rolled up, not sorted beside what makes them."""
    parts = spark.createDataFrame([], "id long, part_number string, part_number_raw string, brand string, description string, quantity int, listed_quantity int, ebay_listing_id string")
    adds = spark.range(5).selectExpr("id AS seq", "concat('p', id % 2) AS part_number", "'b' AS brand", "'d' AS description", "1 AS quantity", "'n' AS note").groupBy("seq", "part_number", "brand", "description", "note").agg(F.sum("quantity").alias("quantity"))
    plan = _plan(lambda: inventory.add_parts(parts, adds)[0], spark, capsys)
    below = [x.split("Aggregate(")[0] for x in plan.split("partial_min_by")[1:]]
    assert below and all("Sort [number" in x and "Exchange hashpartitioning(number" in x for x in below)
