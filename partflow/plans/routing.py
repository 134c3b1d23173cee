"""Composite plans: invoice routing, rule acceptance and label reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partflow.functions.text import BAD_BRANDS, BAD_COURIERS, label_fields, let, repair_tracking, valid_tracking, valid_word
from partflow.operators import extraction, vendors
from partflow.sources import tables
from partflow.sources.scratch import stored


def _routed(docs: DataFrame, templates: DataFrame, now: Column, mode: str) -> DataFrame:
    """The documents with items of their template, route, outcome and wants_rule, all on the document's row.

    One join with the (bounded) rule table; rules are applied once.
    """
    if mode == "llm":
        blank = {"route": F.lit("direct"), "outcome": F.lit(None).cast("boolean"), "wants_rule": F.lit(False), "items": F.array().cast(extraction.ITEMS)}
        return docs.withColumns(blank)
    state = vendors.template_state(templates, now).select(F.col("id").alias("_state"), "usable", "unreliable", "in_cooldown", "may_regenerate")
    rules = extraction.parse_rules(templates).join(state.where("usable AND NOT unreliable"), F.col("id") == F.col("_state"), "left_semi")
    scored = let(F.col("items"), lambda x: F.struct(x.alias("items"), extraction.item_score(x).alias("score")))
    known = extraction.item_arrays(docs, rules).withColumn("_scored", scored).join(state, F.col("template_id") == F.col("_state"), "left")
    route = (
        F.when(F.col("usable").isNull(), "fallback-new").when(~F.col("usable") & F.col("in_cooldown"), "direct-cooldown").when(~F.col("usable"), "fallback-retry")
        .when(F.col("unreliable"), "fallback-unreliable").when(F.size("_scored.items") == 0, "fallback-empty").when(F.col("_scored.score") >= 50, "template").otherwise("direct-insane")
    )
    marked = known.withColumn("route", route)
    domain_miss = (F.col("route") == "fallback-empty") & (F.col("confidence") == "domain")
    outcome = F.when(F.col("route") == "template", True).when((F.col("route") == "direct-insane") | domain_miss, False)
    wants = F.col("route").isin("fallback-new", "fallback-retry", "fallback-unreliable") | (domain_miss & F.col("may_regenerate"))
    return marked.select(*docs.columns, "route", outcome.alias("outcome"), F.coalesce(wants, F.lit(False)).alias("wants_rule"), F.col("_scored.items").alias("items"))


def _with_costs(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and items with shipping and tax (0 or null: unknown) spread over them; totals are recovered from the text."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    found = extraction.recover_totals(docs.select(*keep, *(c for c in ("text",) if c not in keep), "items", zero("tax"), zero("shipping")), (*keep, "items"))
    return found.withColumn("items", extraction.allocated(F.col("items"), F.col("shipping"), F.col("tax")))


def route_documents(docs: DataFrame, templates: DataFrame, now: Column, mode: str = "template") -> tuple[DataFrame, DataFrame]:
    """(routes, items) of documents (doc_id, text, template_id, confidence; null: no vendor matched).

    A route is direct, fallback-new, direct-cooldown, fallback-retry, fallback-unreliable, template,
    direct-insane or fallback-empty. Items are those of the template route, with shipping and tax
    recovered from the text and spread over them; ``extract_documents`` gives those of all routes. ``outcome`` is what the template's counters get (true,
    false or null), ``wants_rule`` whether a new rule may be made.
    """
    routed = _routed(docs, templates, now, mode)
    good = routed.where("route = 'template'").withColumns({"tax": F.lit(0.0), "shipping": F.lit(0.0)})
    return routed.select("doc_id", "template_id", "route", "outcome", "wants_rule"), extraction.exploded(_with_costs(good, ("doc_id",)))


def _extracted(docs: DataFrame, templates: DataFrame, now: Column, responses: DataFrame, mode: str, keep: tuple[str, ...]) -> DataFrame:
    """One row a document: ``keep``, route, outcome, wants_rule, metadata and items with their costs."""
    r = lambda c: F.col(f"response.{c}")
    supplied = F.transform(
        F.coalesce(r("items"), F.array()),
        lambda i, pos: F.struct(pos.alias("item_pos"), F.coalesce(i["partNumber"], F.lit("")).alias("part_number"), F.coalesce(i["partName"], F.lit("")).alias("part_name"), F.coalesce(i["quantity"], F.lit(1.0)).alias("quantity"), i["unitPrice"].alias("unit_price"), i["brand"].alias("brand")),
    ).cast(extraction.ITEMS)
    known = _routed(docs, templates, now, mode).join(responses.select("doc_id", "response"), "doc_id", "left")
    known = known.withColumns({"items": F.when(F.col("route") == "template", F.col("items")).otherwise(supplied), "tax": r("totalTax"), "shipping": r("totalShipping")})
    spread = _with_costs(known, (*keep, "text", "route", "outcome", "wants_rule", "response"))
    numbers = F.array_distinct(F.transform("items", lambda x: x["part_number"]))
    return spread.select(
        *keep, "route", "outcome", "wants_rule", r("vendor").alias("vendor"), r("orderNumber").alias("order_number"), r("orderDate").alias("order_date"), r("technicianName").alias("technician_name"),
        valid_tracking(repair_tracking(r("trackingNumber"), F.col("text")), r("orderNumber"), numbers).alias("tracking_number"), valid_word(r("deliveryCourier"), BAD_COURIERS).alias("delivery_courier"),
        F.transform("items", lambda x: x.withField("brand", valid_word(x["brand"], BAD_BRANDS))).alias("items"),
    )


METADATA = ("vendor", "order_number", "order_date", "technician_name", "tracking_number", "delivery_courier")


def extract_documents(docs: DataFrame, templates: DataFrame, now: Column, responses: DataFrame, mode: str = "template") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, metadata, items) of documents on every route; documents as for ``route_documents``.

    ``responses`` (doc_id, response), one a document, come from ``tables.parse_responses``. They give the items of all
    routes but template, and metadata and totals of all. Totals that are 0 or absent are read from the text;
    tracking is repaired, then tracking, courier and brands are sanitised. Documents without a response keep null metadata.
    What is found is written down once, without the texts, so that the three results read it and extract nothing again.
    """
    done = stored(_extracted(docs, templates, now, responses, mode, ("doc_id", "template_id")), "extracted")
    return done.select("doc_id", "template_id", "route", "outcome", "wants_rule"), done.select("doc_id", *METADATA), extraction.exploded(done)


def parse_documents(docs: DataFrame, templates: DataFrame, now: Column, responses: DataFrame, ocr: DataFrame, mode: str = "template") -> DataFrame:
    """Documents (doc_id, text) end to end, one row each, with their items as an array.

    Form feeds are cleaned and short texts rejected (rejected_reason; no route); texts of poor quality are
    supplemented by ``ocr`` (doc_id, content); the vendor is detected; then as ``extract_documents``. What
    the counters of templates get stands in outcome, with template_id. ``docs`` are read once: cleaned texts and their
    verdicts are written down, and so are the texts of poor quality once they are supplemented, which alone move to meet
    ``ocr``; all else reads them from there.
    """
    clean = extraction.with_quality(tables.documents(docs.select("doc_id", "text")))
    clean = stored(clean.withColumn("quality_issue", F.when(F.col("rejected_reason").isNull(), F.col("quality_issue"))), "texts")
    good = clean.where("rejected_reason IS NULL").drop("rejected_reason")
    poor = stored(tables.supplement_text(good.where("quality_issue IS NOT NULL"), ocr), "supplemented")
    full = good.where("quality_issue IS NULL").unionByName(poor)
    matched = full.join(vendors.detect_vendor(full, templates), "doc_id", "left")
    done = _extracted(matched, templates, now, responses, mode, ("doc_id", "template_id", "confidence", "quality_issue"))
    rejected = clean.where("rejected_reason IS NOT NULL").select("doc_id", "rejected_reason")
    return done.withColumn("rejected_reason", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)


def spot_checked(docs: DataFrame, templates: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, picked, items) of documents (as for ``route_documents``, with their order seq) for spot checks.

    ``outcomes`` (template_id, ok) are what routes give to the counters of templates; ``picked`` (doc_id, template_id) are the
    successes to be checked, and ``items`` theirs, as their rule reads them. Documents are read once, and no costs are worked out.
    """
    routed = stored(_routed(docs, templates, now, "template").select("doc_id", "template_id", "seq", F.col("outcome").alias("ok"), "items"), "routed")
    picked = stored(extraction.spot_checks(routed.where("ok").drop("items"), templates).select("doc_id", "template_id"), "picked")
    return routed.where("ok IS NOT NULL").select("template_id", "ok"), picked, extraction.exploded(routed.where("ok").join(picked, "doc_id", "left_semi"))


def accept_rules(docs: DataFrame, templates: DataFrame, supplied: DataFrame) -> DataFrame:
    """(id, accepted) of candidate templates: static checks pass and every sample document (doc_id, text, template_id) is reproduced."""
    rules = extraction.parse_rules(templates)
    checked = extraction.check_rules(rules).select("id", "acceptable")
    items = extraction.extract_items(docs, rules)
    agreed = extraction.compare_extractions(items, supplied).join(docs.select("doc_id", "template_id"), "doc_id")
    by_rule = agreed.groupBy(F.col("template_id").alias("id")).agg(F.min(F.col("agrees").cast("int")).alias("agrees"))
    return by_rule.join(checked, "id").select("id", (F.col("acceptable") & (F.col("agrees") == 1)).alias("accepted"))


def learn_rules(docs: DataFrame, candidates: DataFrame, supplied: DataFrame, templates: DataFrame, now: Column) -> DataFrame:
    """The templates after candidate rules were tried on sample documents (doc_id, text, vendor_key) with supplied items.

    A vendor's candidates (seq, vendor_key, vendor_name, vendor_domains, vendor_keywords, extraction_rules) are tried in the
    order of ``seq``: a first answer, its repair, another model's. The first that is accepted replaces the vendor's template
    or becomes a new one; a vendor without one gets a failure, on its template or on a stub.
    """
    tried = docs.join(candidates.select("seq", "vendor_key"), "vendor_key")
    each = F.struct("doc_id", "seq").alias("doc_id")  # a document is read by each candidate of its vendor
    given = supplied.join(tried.select("doc_id", "seq"), "doc_id").select(each, *(c for c in supplied.columns if c != "doc_id"))
    fits = accept_rules(tried.select(each, "text", F.col("seq").alias("template_id")), candidates.withColumn("id", F.col("seq")), given)
    judged = candidates.join(fits.where("accepted").select(F.col("id").alias("_fits")), F.col("seq") == F.col("_fits"), "left")
    first = judged.groupBy("vendor_key").agg(F.min("_fits").alias("_taken"), F.min("seq").alias("_first"))
    judged = stored(judged.drop("_fits").join(first, "vendor_key"), "candidates")
    taken = judged.where("seq = _taken").drop("_taken", "_first")
    failed = judged.where("_taken IS NULL AND seq = _first").drop("_taken", "_first")
    return vendors.record_failed_attempts(vendors.upsert_templates(templates, taken, now), failed, now)


def read_labels(docs: DataFrame, supplied: DataFrame) -> DataFrame:
    """Label fields of OCR texts (doc_id, text); what the text does not show comes from supplied responses."""
    found = docs.select("doc_id", label_fields(F.col("text")).alias("f")).select("doc_id", "f.*")
    names = [c for c in found.columns if c != "doc_id"]
    other = supplied.select("doc_id", *(F.col(c).alias(f"_{c}") for c in names))
    return found.join(other, "doc_id", "left").select("doc_id", *(F.coalesce(c, f"_{c}").alias(c) for c in names))
