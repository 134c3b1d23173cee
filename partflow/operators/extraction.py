"""Line items from document text by rules stored as data, with quality gates, repair and cost allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partflow.functions.text import let, literal_fraction, normalize_part_number, round2, trim_all
from partflow.sources import schemas

GROUPS = ("partNumber", "description", "partName", "quantity", "unitPrice", "brand")
REQUIRED_GROUPS = ("partNumber", "quantity", "unitPrice")


def text_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, quality_issue) of documents."""
    return with_quality(docs).select("doc_id", "quality_issue")


def with_quality(docs: DataFrame) -> DataFrame:
    """Documents with their quality_issue: orphan-numbers, fragment-soup, label-dump, duplicate-text or null, in this order.

    Lines are judged by folds over the array of a document's lines, so no line leaves its row.
    """
    text = F.col("text")
    lines = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")

    def run(test, n: int) -> Column:
        """Whether n lines in a row pass the test; a line is tested once, and the fold is made only where n lines pass at all."""
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
        step = lambda s, x: F.struct(F.when(x, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(x, s["run"] + 1).otherwise(0)).alias("best"))
        return let(F.transform("_lines", test), lambda hits: (F.size(F.filter(hits, lambda x: x)) >= n) & (F.aggregate(hits, start, step)["best"] >= n))

    numeric = run(lambda x: x.rlike(r"^\$?\d[\d,.]*$"), 3)
    short = F.size(F.filter("_lines", lambda x: F.char_length(x) <= 3))
    soup = (F.size("_lines") >= 10) & (short / F.greatest(F.size("_lines"), F.lit(1)) > 0.4)
    labels = run(lambda x: (F.char_length(x) < 40) & x.rlike(r"^[A-Za-z][A-Za-z &/\-#.]+:?\s*$"), 5)
    half = F.floor(F.char_length(text) / 2).cast("int")
    sample = F.substring(text, F.lit(1), F.least(half, F.lit(100)))
    twice = (F.char_length(text) > 200) & F.contains(F.substring(text, half + 1, F.char_length(text)), sample)
    rows = docs.withColumn("_lines", lines)
    issue = F.when(F.size("_lines") == 0, None).when(numeric, "orphan-numbers").when(soup, "fragment-soup").when(labels, "label-dump").when(twice, "duplicate-text")
    return rows.withColumn("quality_issue", issue).drop("_lines")


def parse_rules(templates: DataFrame) -> DataFrame:
    """Templates with their rules decoded: start, end, row, and the number of each named group (0: absent).

    A group's number is one more than the opening groups before it in the row pattern. A pattern that does
    not compile never stops a job: as a row it gives no items (``row_compiles`` says so), as start or end it
    is found nowhere.
    """
    rules = F.from_json("extraction_rules", schemas.RULES)
    written = lambda c: F.coalesce(rules["lineItems"][c], F.lit(""))
    compiles = lambda c: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c).isNotNull()
    row = F.when(compiles(written("row")), written("row")).otherwise("")
    bound = lambda c: F.when(compiles(written(c)), written(c)).otherwise("(?!)")

    def number(name: str) -> Column:
        head = F.substring_index(row, f"(?<{name}>", 1)
        plain = F.regexp_replace(head, r"\\.|\[(?:\\.|[^\]\\])*\]", "")
        before = F.size(F.regexp_extract_all(plain, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"), F.lit(0)))
        return F.when(F.contains(row, F.lit(f"(?<{name}>")), before + 1).otherwise(0)

    named = {f"g_{g}": number(g) for g in GROUPS}
    return templates.select("id", bound("start").alias("start"), bound("end").alias("end"), row.alias("row"), compiles(written("row")).alias("row_compiles"), *(c.alias(n) for n, c in named.items()))


ITEM = "item_pos int, part_number string, part_name string, quantity double, unit_price double, brand string"
ITEMS = f"array<struct<{', '.join(':'.join(x.split()) for x in ITEM.split(', '))}>>"


def item_arrays(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """The documents (doc_id, text, template_id and any others) with their ``items``, an array of ``ITEM`` in text order.

    The region after ``start`` up to ``end`` is read; the whole text where ``start`` is absent, or where a
    region of under 100 characters gives nothing. ``rules`` come from ``parse_rules``, one row a template;
    documents without a rule have no items. Nothing is exploded, so what follows needs no join.
    """
    known = rules.select(F.col("id").alias("_rule"), "start", "end", "row", *(f"g_{g}" for g in GROUPS))
    joined = docs.join(known, docs["template_id"] == known["_rule"], "left")
    text, row, i = F.col("text"), F.col("row"), lambda c: F.concat(F.lit("(?i)"), F.col(c))
    at = F.when(F.col("start") != "", F.regexp_instr("text", i("start"))).otherwise(1)
    width = F.when(F.col("start") != "", F.char_length(F.regexp_substr("text", i("start")))).otherwise(0)
    after = let(at, lambda n: F.when(n > 0, F.substring(text, n + width, F.char_length(text))))
    end = lambda rest: F.when(F.col("end") != "", F.regexp_instr(rest, i("end"))).otherwise(1)
    region = let(after, lambda rest: let(end(rest), lambda n: F.when(n > 0, F.substring(rest, F.lit(1), n - 1)).otherwise(rest)))
    hits = lambda c: F.regexp_extract_all(c, row, F.lit(0))
    source = let(region, lambda r: F.when(r.isNull() | ((F.char_length(r) < 100) & (F.size(hits(r)) == 0)), text).otherwise(r))

    def zipped(c: Column) -> Column:
        n = {g: F.col(f"g_{g}") for g in GROUPS}
        found = {g: F.when(n[g] > 0, F.regexp_extract_all(c, row, n[g])) for g in GROUPS}
        return let(F.struct(hits(c).alias("hit"), *(v.alias(g) for g, v in found.items())), lambda f: F.transform(f["hit"], lambda x, k: F.struct(x.alias("hit"), *(F.get(f[g], k).alias(g) for g in GROUPS))))

    kept = F.filter(let(source, zipped), lambda x: ~x["hit"].rlike("(?i)payment"))

    def item(x: Column, pos: Column) -> Column:
        name = F.when(x["description"].isNotNull(), x["description"]).otherwise(F.coalesce(x["partName"], F.lit("")))
        digits = F.regexp_extract(x["quantity"], r"^\s*([+-]?\d+)", 1).try_cast("double")
        price = F.regexp_extract(x["unitPrice"], r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
        return F.struct(
            pos.alias("item_pos"), trim_all(F.coalesce(x["partNumber"], F.lit(""))).alias("part_number"), trim_all(name).alias("part_name"),
            F.coalesce(F.nullif(digits, F.lit(0.0)), F.lit(1.0)).alias("quantity"), F.when(F.coalesce(x["unitPrice"], F.lit("")) != "", price).alias("unit_price"), trim_all(x["brand"]).alias("brand"),
        )

    found = F.when(row != "", F.transform(kept, item))
    return joined.select(*docs.columns, F.coalesce(found, F.array()).cast(ITEMS).alias("items"))


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """One row an item of the documents' ``items``."""
    # The outer form: the plain one would have the optimiser test the items before they are made, and so make them twice.
    return docs.select(*(keep or ("doc_id",)), F.inline_outer("items")).where("item_pos IS NOT NULL")


def extract_items(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Items (doc_id and ``ITEM``) of documents (doc_id, text, template_id), one row each."""
    return exploded(item_arrays(docs, rules))


def allocated(items: Column, shipping: Column, tax: Column) -> Column:
    """An array of items with ship_cost and tax_price for each unit: the totals spread by line value.

    Where a document's lines are worth nothing all items get the same. Cents that rounding leaves over
    are not given out again.
    """
    line = lambda x: F.coalesce(x["unit_price"], F.lit(0.0)) * x["quantity"]
    total = F.aggregate(items, F.lit(0.0), lambda s, x: s + line(x))

    def spread(x: Column, sum_: Column) -> Column:
        part = F.when(sum_ > 0, line(x) / sum_).otherwise(F.lit(1.0) / F.size(items))
        units = F.when(x["quantity"] != 0, x["quantity"]).otherwise(1.0)
        share = lambda c: round2(round2(F.coalesce(c, F.lit(0.0)) * part) / units)
        return x.withField("unit_price", round2(x["unit_price"])).withField("ship_cost", share(shipping)).withField("tax_price", share(tax))

    return let(total, lambda sum_: F.transform(items, lambda x: spread(x, sum_)))


def allocate_costs(items: DataFrame, totals: DataFrame) -> DataFrame:
    """As ``allocated`` for items that are rows: totals (doc_id, total_shipping, total_tax) spread over them."""
    line = F.coalesce("unit_price", F.lit(0.0)) * F.col("quantity")
    sums = items.groupBy("doc_id").agg(F.sum(line).alias("_sub"), F.count("*").alias("_n")).join(totals, "doc_id", "left")
    joined = items.join(sums, "doc_id")
    part = F.when(F.col("_sub") > 0, line / F.col("_sub")).otherwise(F.lit(1.0) / F.col("_n"))
    qty = F.when(F.col("quantity") != 0, F.col("quantity")).otherwise(1.0)
    share = lambda c: round2(round2(F.coalesce(c, F.lit(0.0)) * part) / qty)
    return joined.withColumns({"unit_price": round2(F.col("unit_price")), "ship_cost": share("total_shipping"), "tax_price": share("total_tax")}).drop("_sub", "_n", "total_shipping", "total_tax")


def _penalty(pn: Column, price: Column, qty: Column) -> Column:
    none = F.lit(0)
    return (
        F.when(pn.isNull() | (F.char_length(trim_all(pn)) < 2), 25).when(~pn.rlike("(?i)[A-Z0-9]"), 20).when(pn.rlike(r"^\d{1,2}$"), 25).otherwise(none)
        + F.when(price < 0, 20).otherwise(none) + F.when(price > 50000, 10).otherwise(none)
        + F.when(qty <= 0, 20).when(qty != F.floor(qty), 10).otherwise(none) + F.when((price > 0) & (price == qty), 15).otherwise(none)
    )


def item_score(items: Column) -> Column:
    """The score of an array of items: 100 less their penalties, at least 0; no items score 0."""
    lost = F.aggregate(items, F.lit(0), lambda s, x: s + _penalty(x["part_number"], x["unit_price"], x["quantity"]))
    return F.when(F.size(items) == 0, 0).otherwise(F.greatest(F.lit(0), 100 - lost))


def item_failures(items: Column) -> Column:
    """What is wrong with the items of an array, item by item in order."""

    def plain(x: Column) -> Column:
        return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))

    def of(x: Column, i: Column) -> Column:
        label = F.when(F.size(items) > 1, F.concat(F.lit("Item "), (i + 1).cast("string"))).otherwise("Item")
        pn, price, qty = x["part_number"], x["unit_price"], x["quantity"]
        said = lambda *text: F.concat(label, F.lit(": "), *(F.lit(t) if isinstance(t, str) else t for t in text))
        number = (
            F.when(pn.isNull() | (F.char_length(trim_all(pn)) < 2), said("missing or too-short part number"))
            .when(~pn.rlike("(?i)[A-Z0-9]"), said('part number "', pn, '" has no alphanumeric chars'))
            .when(pn.rlike(r"^\d{1,2}$"), said('part number "', pn, '" looks like a number, not a part'))
        )
        amount = F.when(qty <= 0, said("quantity is ", plain(qty))).when(qty != F.floor(qty), said("quantity ", plain(qty), " is not a whole number"))
        swapped = F.when((price > 0) & (price == qty), said("unit price equals quantity (", plain(price), ") -- possible column swap"))
        return F.array(number, F.when(price < 0, said("negative unit price ", plain(price))), F.when(price > 50000, said("unit price ", plain(price), " seems unreasonably high")), amount, swapped)

    every = F.filter(F.flatten(F.transform(items, of)), lambda m: m.isNotNull())
    return F.when(F.size(items) == 0, F.array(F.lit("No items extracted"))).otherwise(every)


def sanity_score(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, score, pass, failures): 100 less the penalties of a document's items, at least 0; 50 passes; no items score 0.

    A document's items stand in one array, in the order of item_pos (then of their other fields).
    """
    fields = ("item_pos", "part_number", "part_name", "quantity", "unit_price")
    lists = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_items"))
    none = F.array().cast(lists.schema["_items"].dataType)
    rows = docs.select("doc_id").join(lists, "doc_id", "left").withColumn("_items", F.coalesce("_items", none))
    rows = rows.select("doc_id", item_score(F.col("_items")).cast("int").alias("score"), item_failures(F.col("_items")).alias("failures"))
    return rows.select("doc_id", "score", (F.col("score") >= 50).alias("pass"), "failures")


def validate_extraction(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_count, valid, issues) of extractions: identified items, quantities, prices, identical names."""
    name, pn = F.coalesce("part_name", F.lit("")), F.coalesce("part_number", F.lit(""))
    stats = items.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if((F.char_length(name) > 2) | (F.char_length(pn) > 2)).alias("known"), F.count_if((F.col("quantity") < 1) | (F.col("quantity") != F.floor("quantity"))).alias("bad_qty"),
        F.count_if((F.col("unit_price") < 0.01) | (F.col("unit_price") > 50000)).alias("bad_price"), F.count_if(name != "").alias("names"),
        F.min(F.nullif(name, F.lit(""))).alias("low"), F.max(F.nullif(name, F.lit(""))).alias("high"),
    )
    joined = docs.select("doc_id").join(stats, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    found = F.array(
        F.when(n == 0, "No items extracted"), F.when((n > 0) & (2 * F.col("known") < n), "Less than 50% of items have identifiable names or part numbers"),
        F.when(F.col("bad_qty") > 0, F.concat("bad_qty", F.lit(" items have invalid quantities"))), F.when(F.col("bad_price") > 0, F.concat("bad_price", F.lit(" items have unreasonable prices"))),
        F.when((F.col("names") > 2) & (F.col("low") == F.col("high")), "All items have identical names -- selector may be wrong"),
    )
    issues = F.filter(found, lambda x: x.isNotNull())
    return joined.select("doc_id", n.alias("item_count"), (F.size(issues) == 0).alias("valid"), issues.alias("issues"))


def compare_extractions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, agrees, reason): whether extraction ``a`` reproduces ``b``: as many items, no part number missing, prices within 0.01.

    Of items of ``a`` with one part number the first stands for it.
    """
    none = F.lit(None).cast("double")
    ours = a.select("doc_id", "part_number", "item_pos", F.col("unit_price").alias("_ours"), none.alias("_theirs"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    theirs = b.select("doc_id", "part_number", F.lit(None).cast("int").alias("item_pos"), none.alias("_ours"), F.col("unit_price").alias("_theirs"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    # Both sides in one pass, so that an extraction is made once.
    numbers = ours.unionByName(theirs).groupBy("doc_id", "part_number").agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.min_by("_ours", "item_pos").alias("_price"), F.min("_theirs").alias("_low"), F.max("_theirs").alias("_high")
    )
    missing = F.min(F.when((F.col("_b") > 0) & (F.col("_a") == 0) & (F.col("part_number") != ""), F.col("part_number")))
    off = lambda c: F.coalesce(F.abs(F.col("_price") - F.col(c)) > 0.01, F.lit(False))
    far = F.min(F.when(off("_low") | off("_high"), F.col("part_number")))
    verdict = numbers.groupBy("doc_id").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"), missing.alias("_missing"), far.alias("_far")).where("_nb > 0 AND doc_id IS NOT NULL")
    na = F.coalesce("_na", F.lit(0))
    reason = (
        F.when(na < F.col("_nb"), F.concat(F.lit("Template extracted "), na, F.lit(" items, supplied "), "_nb")).when(F.col("_missing").isNotNull(), F.concat(F.lit("Template missing part number: "), "_missing"))
        .when(F.col("_far").isNotNull(), F.concat(F.lit("Price mismatch for "), "_far"))
    )
    return verdict.select("doc_id", reason.isNull().alias("agrees"), reason.alias("reason"))


def check_rules(rules: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(id, literal_fraction, missing_groups, holds_literal, nested_quantifier, row_compiles, acceptable) of parsed rules.

    ``items`` (template_id and item columns of the sample the rule was made from) adds the check that no
    value of the sample stands in a pattern. Nested quantifiers are refused since Java's matcher backtracks.
    """
    row = F.col("row")
    lost = F.filter(F.array(*(F.when(~F.contains(row, F.lit(f"(?<{g}>")), F.lit(g)) for g in REQUIRED_GROUPS)), lambda x: x.isNotNull())
    nested = row.rlike(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]")
    out = rules.select("id", literal_fraction(row).alias("literal_fraction"), lost.alias("missing_groups"), nested.alias("nested_quantifier"), "row_compiles", "row", "start")
    if items is not None:
        text = F.explode(F.array("part_number", F.when(F.char_length("part_name") > 3, F.col("part_name")), F.col("unit_price").cast("string"))).alias("_value")
        values = items.select(F.col("template_id").alias("id"), text).where("length(_value) > 2")
        held = rules.select("id", "row", "start").join(values, "id").groupBy("id").agg(F.max(F.contains("row", F.col("_value")) | F.contains("start", F.col("_value"))).alias("holds_literal"))
        out = out.join(held, "id", "left")
    else:
        out = out.withColumn("holds_literal", F.lit(False))
    held = F.coalesce("holds_literal", F.lit(False))
    good = (F.size("missing_groups") == 0) & (F.col("literal_fraction") <= 0.5) & ~held & ~F.col("nested_quantifier") & F.col("row_compiles")
    return out.select("id", "literal_fraction", "missing_groups", held.alias("holds_literal"), "nested_quantifier", "row_compiles", good.alias("acceptable"))


# Fixed value: the form of amounts in invoices. Messages of checks and labels of totals in this module are fixed likewise.
_AMOUNT = r"\d[\d,]*\.\d{2}"


def _number(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def recover_totals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, tax and shipping for documents (doc_id, text, tax, shipping; 0 is unknown), read from the text where one is missing.

    First by their labels; then from subtotal, total and stand-alone amounts: the first pair of amounts, in
    the order they first appear, that fills the gap gives both, else the gap gives the one that is missing. Pairs
    are found by looking up what each amount leaves of the gap, so the work grows with the number of amounts.
    """
    b0, b1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    word = lambda w: rf"{w}(?<![A-Za-z0-9_]{w})"  # noqa: E731  what stands before a word is looked at where the word stands, not at every place
    labelled = lambda p: F.coalesce(F.regexp_replace(F.regexp_extract("text", p, 1), ",", "").try_cast("double"), F.lit(0.0))
    tax_at = labelled(rf"(?i){word('tax')}(?:\s+amount)?\s*[:=]?\s*\$?([\d,]+\.?\d*)")
    ship_at = labelled(rf"(?i){word('ship')}(?:ping)?(?:\s*(?:&|and)\s*handling)?\s*(?:charge)?\s*[:=]?\s*\$?([\d,]+\.?\d*)")
    read = lambda name, at: F.when(~known & (F.col(name) == 0), let(at, lambda v: F.when(v > 0, v).otherwise(F.col(name)))).otherwise(F.col(name)).alias(name)
    known = (F.col("tax") > 0) & (F.col("shipping") > 0)
    rows = docs.select(*(c for c in keep if c != "text"), "text", known.alias("_known"), read("tax", tax_at), read("shipping", ship_at))
    lines = F.transform(F.split("text", "\n"), trim_all)
    some = ~((F.col("tax") > 0) & (F.col("shipping") > 0)) & F.col("text").rlike(r"(?i)sub\s*total")  # without a subtotal there is no gap, and no line needs to be read
    rows = rows.withColumn("_lines", F.when(some, lines).otherwise(F.array().cast("array<string>")))
    amounts = lambda x: F.transform(F.regexp_extract_all(x, F.lit(_AMOUNT), F.lit(0)), _number)
    is_sub = lambda x: x.rlike(rf"(?i){b0}sub\s*total{b1}")
    is_total = lambda x: ~is_sub(x) & x.rlike(rf"(?i){b0}total\s*(amount)?{b1}") & ~x.rlike("(?i)sub")
    worded = lambda x: x.rlike(rf"(?i){b0}total{b1}") & ~x.rlike("(?i)sub")

    def last(test, end: int) -> Column:
        found = F.filter(F.transform("_lines", lambda x: F.when(test(x), F.try_element_at(amounts(x), F.lit(end)))), lambda v: v.isNotNull())
        return F.try_element_at(found, F.lit(-1))

    alone = F.array_distinct(F.transform(F.filter("_lines", lambda x: x.rlike(r"^\$?[\d,]+\.\d{2}$")), _number))
    rows = rows.withColumns({"_sub": last(is_sub, 1), "_total": F.coalesce(last(is_total, 1), last(worded, -1)), "_alone": alone})
    near = F.filter("_alone", lambda n: (n > F.col("_sub")) & (n < F.col("_sub") * 2))
    rows = rows.withColumn("_total", F.coalesce("_total", F.when(F.size(near) == 1, F.get(near, F.lit(0)))))
    gap = round2(F.col("_total") - F.col("_sub"))
    rows = rows.withColumn("_gap", F.when(F.col("_total") > F.col("_sub"), gap))
    cents = lambda x: F.round(x * 100).cast("long")
    rows = rows.withColumn("_fit", F.transform(F.filter("_alone", lambda n: (n > 0) & (n <= F.col("_gap"))), cents))
    rest = F.transform("_fit", lambda x: cents(F.col("_gap")) - x)  # an amount whose rest stands among the amounts is one of a pair: a hash lookup each
    one = F.get(F.filter(F.array_intersect("_fit", rest), lambda x: 2 * x != cents(F.col("_gap"))), F.lit(0))
    other = cents(F.col("_gap")) - one
    rows = rows.withColumn("_pair", F.when(one.isNotNull(), F.struct((F.least(one, other) / 100).alias("lo"), (F.greatest(one, other) / 100).alias("hi"))))
    g = F.col("_gap")
    tax = F.when(F.col("_pair").isNotNull(), F.col("_pair.lo")).when(g.isNotNull() & (F.col("tax") == 0) & (F.col("shipping") > 0), round2(g - F.col("shipping"))).otherwise(F.col("tax"))
    ship = F.when(F.col("_pair").isNotNull(), F.col("_pair.hi")).when(g.isNotNull() & (F.col("shipping") == 0) & (F.col("tax") > 0), round2(g - F.col("tax"))).otherwise(F.col("shipping"))
    return rows.select(*keep, tax.alias("tax"), ship.alias("shipping"))


def verify_positional(a: DataFrame, b: DataFrame, fuzzy) -> DataFrame:
    """(doc_id, agrees): counts differ by one at most, and names and prices agree at 70 % of the common positions."""
    counts = a.groupBy("doc_id").agg(F.count("*").alias("_na")).join(b.groupBy("doc_id").agg(F.count("*").alias("_nb")), "doc_id", "full_outer")
    right = b.select("doc_id", "item_pos", F.col("part_name").alias("_name"), F.col("unit_price").alias("_price"))
    both = a.join(right, ["doc_id", "item_pos"]).groupBy("doc_id").agg(
        F.avg(F.coalesce(fuzzy(F.col("part_name"), F.col("_name")), F.lit(False)).cast("int")).alias("_names"), F.avg(F.col("unit_price").eqNullSafe(F.col("_price")).cast("int")).alias("_prices")
    )
    joined = counts.join(both, "doc_id", "left")
    na, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    good = (F.abs(na - nb) <= 1) & (na > 0) & (F.coalesce("_names", F.lit(0.0)) >= 0.7) & (F.coalesce("_prices", F.lit(0.0)) >= 0.7)
    return joined.select("doc_id", good.alias("agrees"))


def spot_checks(successes: DataFrame, templates: DataFrame, every: int = 10) -> DataFrame:
    """Successful extractions (doc_id, template_id, seq) that are to be checked: every tenth of a template, counting earlier ones."""
    turn = F.row_number().over(Window.partitionBy("template_id").orderBy("seq", "doc_id"))
    before = templates.select(F.col("id").alias("template_id"), F.col("success_count").alias("_before"))
    return successes.withColumn("_turn", turn).join(before, "template_id").where((F.col("_before") + F.col("_turn")) % every == 0).drop("_turn", "_before")


def spot_check_outcomes(successes: DataFrame, templates: DataFrame, items: DataFrame, supplied: DataFrame, every: int = 10) -> DataFrame:
    """(template_id, doc_id, ok = false) of spot-checked documents whose items do not reproduce the supplied ones: outcomes for ``template_counters``.

    As in the reference, prices are not compared here: fewer items or a missing part number are a mismatch.
    """
    return spot_check_failures(spot_checks(successes, templates, every), items, supplied)


def spot_check_failures(picked: DataFrame, items: DataFrame, supplied: DataFrame) -> DataFrame:
    """As ``spot_check_outcomes``, for documents that ``spot_checks`` has picked."""
    picked = picked.select("doc_id", "template_id")
    ours = items.join(picked, "doc_id", "left_semi")
    theirs = supplied.join(picked, "doc_id", "left_semi").withColumn("unit_price", F.lit(None).cast("double"))
    return compare_extractions(ours, theirs).where("NOT agrees").join(picked, "doc_id").select("template_id", "doc_id", F.lit(False).alias("ok"))


def stock_requests(items: DataFrame) -> DataFrame:
    """Extracted items as intake requests, by normalised number."""
    return items.where("part_number != ''").select(normalize_part_number(F.col("part_number")).alias("part_number"), F.col("quantity").cast("int").alias("quantity"))
