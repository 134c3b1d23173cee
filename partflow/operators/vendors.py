"""Vendor bookkeeping: domains, detection, rule and preset counters, upserts."""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from partflow.functions.text import normalize_domain
from partflow.operators.numbering import numbered

COOLDOWN_DAYS = 7
FAIL_THRESHOLD = 3
KEYWORD_CHARS = 8 << 20
_WORD = frozenset(string.ascii_letters + string.digits + "_")
# A name is tried where it begins or where the last one ended, not at each of its letters, and is read once.
DOMAIN_TOKEN = r"(?i)(?:(?<![a-z0-9-])|\G)(?:https?://)?(?:www\.)?([a-z0-9-]++\.[a-z]{2,})"
# Names of cookies that carry a session, for two domains and in general.
AUTH_NAMES = {"amazon.com": r"^session-id$|^at-main$|^sess-at-|^x-main$|^ubid-main$", "ebay.com": r"^ebay$|^nonsession$|^ds1$|^s$"}
AUTH_WORDS = r"session|auth|token|sid|login"


def match_domain(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Hosts (column ``host``) with the longest domain that they equal or end in; hosts without one are left out.

    A host is exploded into its suffixes, so the match is an equi-join.
    """
    labels = F.split(F.regexp_replace(F.lower("host"), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    known = domains.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("suffix"), "domain")
    found = asked.join(known, "suffix")
    return found.groupBy("host").agg(F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("domain"))


def detect_vendor(docs: DataFrame, templates: DataFrame, shard_chars: int = KEYWORD_CHARS) -> DataFrame:
    """(doc_id, template_id, confidence): by a domain in the text, else by a whole-word keyword of four or more characters.

    Of several templates the smallest id wins. Domains are an equi-join of the few that a text names. Keywords of at most
    ``shard_chars`` characters together are one automaton, sent to all tasks, which finds them in one pass over a text;
    more are dealt to automata by hash, each with a pass of its own. No text is exploded or moved.
    """
    tokens = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(DOMAIN_TOKEN), F.lit(1)), F.lower))
    seen = docs.select("doc_id", F.explode(tokens).alias("domain"))
    known = templates.select(F.col("id").alias("template_id"), F.explode(F.transform("vendor_domains", F.lower)).alias("domain"))
    found = seen.join(known, "domain").select("doc_id", F.lit(0).alias("rank"), "template_id")
    keys = templates.select(F.col("id").cast("long").alias("template_id"), F.explode(F.transform(F.filter("vendor_keywords", lambda k: F.length(k) >= 4), F.lower)).alias("keyword"))
    keys = keys.groupBy("keyword").agg(F.min("template_id").alias("template_id"))
    shards = -(-(keys.agg(F.sum(F.length("keyword"))).first()[0] or 0) // shard_chars)
    for shard in range(shards):
        part = keys if shards == 1 else keys.where(F.pmod(F.xxhash64("keyword"), F.lit(shards)) == shard)
        words = {r.keyword: r.template_id for r in part.toLocalIterator()}  # about shard_chars characters
        if words:
            found = found.unionByName(_by_keyword(docs, words).withColumn("rank", F.lit(1)))
    best = found.groupBy("doc_id").agg(F.min(F.struct("rank", "template_id")).alias("b"))
    return best.select("doc_id", "b.template_id", F.when(F.col("b.rank") == 0, "domain").otherwise("keyword").alias("confidence"))


def _by_keyword(docs: DataFrame, keywords: dict[str, int]) -> DataFrame:
    """(doc_id, template_id): the smallest id of the keywords that a text holds as whole words, in any ASCII case."""
    sent = docs.sparkSession.sparkContext.broadcast(keywords)
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word, template in sent.value.items():
            automaton.add_word(word, (len(word), template))
        automaton.make_automaton()
        for batch in batches:
            best = []
            for text in pc.ascii_lower(batch.column(1)).to_pylist():
                low, least = text or "", None
                for end, (size, template) in automaton.iter(low):
                    if (least is None or template < least) and _edge(low, end + 1 - size) and _edge(low, end + 1):
                        least = template
                best.append(least)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int64())], ["doc_id", "template_id"])
            yield out.filter(out.column(1).is_valid())

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, template_id long")


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    return (at > 0 and text[at - 1] in _WORD) != (at < len(text) and text[at] in _WORD)


def template_state(templates: DataFrame, now: Column) -> DataFrame:
    """Templates with what may be done with them: usable, unreliable, in_cooldown, may_regenerate."""
    row = F.get_json_object("extraction_rules", "$.lineItems.row")
    usable = F.coalesce(row, F.lit("")) != ""
    unreliable = (F.col("fail_count") > 3) & (F.col("success_count") < F.col("fail_count"))
    next_fail = (F.col("fail_count") + 1 > 3) & (F.col("success_count") < F.col("fail_count") + 1)
    cooling = F.coalesce(now - F.expr(f"INTERVAL {COOLDOWN_DAYS} DAYS") < F.col("last_generation_attempt"), F.lit(False))
    return templates.withColumns({"usable": usable, "unreliable": unreliable, "in_cooldown": cooling, "may_regenerate": next_fail})


def preset_eligible(presets: DataFrame, threshold: int = FAIL_THRESHOLD) -> DataFrame:
    return presets.where(F.col("fail_count") < threshold)


def match_preset(pages: DataFrame, presets: DataFrame) -> DataFrame:
    """Pages (vendor_key, input_type, page_fingerprint) with their eligible preset, if any."""
    keys = ["vendor_key", "input_type", "page_fingerprint"]
    return pages.join(preset_eligible(presets).select(*keys, F.col("id").alias("preset_id"), "selectors"), keys, "left")


def template_counters(templates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Templates with successes and failures added (outcomes: template_id, ok)."""
    more = outcomes.groupBy("template_id").agg(F.count_if("ok").cast("int").alias("_s"), F.count_if(~F.col("ok")).cast("int").alias("_f"))
    joined = templates.join(more, templates["id"] == more["template_id"], "left").drop("template_id")
    return joined.withColumns({"success_count": F.col("success_count") + F.coalesce("_s", F.lit(0)), "fail_count": F.col("fail_count") + F.coalesce("_f", F.lit(0))}).drop("_s", "_f")


def preset_counters(presets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Presets after outcomes (preset_id, seq, ok): a success sets failures to 0; ``disabled`` at the threshold.

    A partial aggregate finds the last success, a second counts failures after it.
    """
    last = outcomes.groupBy("preset_id").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("_last"), F.count_if("ok").cast("int").alias("_s"))
    after = outcomes.join(last, "preset_id").groupBy("preset_id", "_last", "_s").agg(F.count_if(~F.col("ok") & (F.col("_last").isNull() | (F.col("seq") > F.col("_last")))).cast("int").alias("_f"))
    joined = presets.join(after, presets["id"] == after["preset_id"], "left").drop("preset_id")
    start = F.when(F.col("_last").isNotNull(), 0).otherwise(F.col("fail_count"))
    joined = joined.withColumns({"success_count": F.col("success_count") + F.coalesce("_s", F.lit(0)), "fail_count": start + F.coalesce("_f", F.lit(0))}).drop("_s", "_f", "_last")
    return joined.withColumn("disabled", F.col("fail_count") >= FAIL_THRESHOLD)


def earliest_expiry(rows: DataFrame) -> DataFrame:
    """For each domain the earliest expiry (seconds, not 0) of rows (domain, name, expiry) whose name carries a session."""
    special = F.create_map(*(F.lit(x) for pair in AUTH_NAMES.items() for x in pair))
    pattern = F.coalesce(F.try_element_at(special, F.col("domain")), F.lit(AUTH_WORDS))
    fits = F.regexp_like("name", F.concat(F.lit("(?i)"), pattern))
    return rows.groupBy("domain").agg(F.min(F.when(fits & (F.col("expiry") != 0), F.col("expiry"))).alias("expiry"))


def template_report(templates: DataFrame) -> DataFrame:
    return templates.select("id", "vendor_key", "vendor_name", F.size("vendor_domains").alias("domains"), F.size("vendor_keywords").alias("keywords"), "success_count", "fail_count").orderBy("vendor_name", "id")


def _with_ids(joined: DataFrame, target: DataFrame, order: str, tie: str, keys: list[str]) -> DataFrame:
    """``joined`` with ``_id`` for rows without an id: numbers after the largest of ``target``, by ``order``."""
    fresh = numbered(joined.where("id IS NULL").select(*keys, F.col(order).alias("_order")), "_order", tie)
    last = F.coalesce(target.agg(F.max("id")).scalar(), F.lit(0))
    ids = fresh.select(*(F.col(k).alias(f"{k}_") for k in keys), (F.col("position") + last).cast("long").alias("_id"))
    same = F.col("id").isNull()
    for k in keys:
        same &= F.col(k) == F.col(f"{k}_")
    return joined.join(ids, same, "left")


def _merged(target: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The target with ``values`` of the last row a key (by seq), ids of new keys in order after the largest."""
    last = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where("_turn = 1")
    new = last.select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_new"), "seq", *(v.alias(f"_{c}") for c, v in values.items()))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    joined = target.join(new, same, "full_outer")
    if "id" in target.columns:
        joined = _with_ids(joined, target, "seq", f"_{keys[0]}", [f"_{k}" for k in keys])
    hit = F.coalesce("_new", F.lit(False))
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.coalesce(c, f"_{c}").alias(c))
        elif c == "id":
            columns.append(F.coalesce("id", "_id").alias("id"))
        elif c in values:
            columns.append(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def upsert_templates(templates: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Accepted rules (seq, vendor_key, vendor_name, vendor_domains, vendor_keywords, extraction_rules) by key: counters start at 0."""
    values = {c: F.col(c) for c in ("vendor_name", "vendor_domains", "vendor_keywords", "extraction_rules")}
    return _merged(templates, rows, ["vendor_key"], values | {"success_count": F.lit(0), "fail_count": F.lit(0), "last_generation_attempt": now})


def record_failed_attempts(templates: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Failed attempts (seq, vendor_key, vendor_name, vendor_domains, vendor_keywords): a stub with one failure each, or more failures and a new attempt time.

    A stub has the name and signals of the key's first attempt, an empty rule, and an id after the largest.
    """
    first = lambda c: F.min_by(c, "seq").alias(f"_{c}")
    tried = rows.groupBy(F.col("vendor_key").alias("_key")).agg(F.count("*").cast("int").alias("_n"), F.min("seq").alias("_seq"), first("vendor_name"), first("vendor_domains"), first("vendor_keywords"))
    joined = _with_ids(templates.join(tried, templates["vendor_key"] == tried["_key"], "full_outer"), templates, "_seq", "_key", ["_key"])
    hit, none = F.col("_key").isNotNull(), F.array().cast("array<string>")
    signals = F.struct(F.col("_vendor_domains").alias("domains"), F.col("_vendor_keywords").alias("keywords"))
    empty = F.struct(F.lit("").alias("start"), F.lit("").alias("end"), F.lit("").alias("row"))
    stub = F.to_json(F.struct(F.col("_vendor_name").alias("vendorName"), signals.alias("vendorSignals"), none.alias("fields"), empty.alias("lineItems"), none.alias("totals")))
    old = F.col("id").isNotNull()
    changed = {
        "id": F.coalesce("id", "_id"), "vendor_key": F.coalesce("vendor_key", "_key"), **{c: F.when(old, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("vendor_name", "vendor_domains", "vendor_keywords")},
        "extraction_rules": F.when(old, F.col("extraction_rules")).otherwise(stub), "success_count": F.coalesce("success_count", F.lit(0)), "fail_count": F.coalesce("fail_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_generation_attempt": F.when(hit, now).otherwise(F.col("last_generation_attempt")),
    }
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in templates.columns))


def upsert_presets(presets: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Learned selectors (seq, keys, selectors, sample_snippet): success 1, failures 0, snippet cut at 2000 characters."""
    values = {"selectors": F.col("selectors"), "sample_snippet": F.substring("sample_snippet", 1, 2000), "success_count": F.lit(1), "fail_count": F.lit(0), "last_used_at": now}
    return _merged(presets, rows, ["vendor_key", "input_type", "page_fingerprint"], values)


def domain_status(domains: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Domains after fetch outcomes (domain, seq, outcome ok/login/captcha/error): a captcha leaves the status as it was."""
    status = F.when(F.col("outcome") == "ok", "active").when(F.col("outcome") == "login", "needs_reauth").otherwise("error")
    last = outcomes.where("outcome != 'captcha'").groupBy("domain").agg(F.max_by(status, F.col("seq")).alias("_status"))
    return domains.join(last, "domain", "left").withColumn("status", F.coalesce("_status", "status")).select(*domains.columns)


def upsert_domains(domains: DataFrame, rows: DataFrame) -> DataFrame:
    """Uploaded domains (seq, domain, vendor_name, auth_cookie_expiry) by normalised domain; their status becomes active."""
    values = {"vendor_name": F.col("vendor_name"), "auth_cookie_expiry": F.col("auth_cookie_expiry"), "status": F.lit("active")}
    return _merged(domains, rows.withColumn("domain", normalize_domain(F.col("domain"))), ["domain"], values)


def delete_domains(domains: DataFrame, ids: DataFrame) -> DataFrame:
    """User-added domains leave; preset domains are reset to unconfigured."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    marked = domains.join(gone, domains["id"] == gone["_gone"], "left").where("_gone IS NULL OR is_preset")
    reset = F.col("_gone").isNotNull()
    return marked.withColumns({"status": F.when(reset, "unconfigured").otherwise(F.col("status")), "auth_cookie_expiry": F.when(~reset, F.col("auth_cookie_expiry"))}).select(*domains.columns)


def delete_templates(templates: DataFrame, ids: DataFrame) -> DataFrame:
    return templates.join(ids.select("id"), "id", "left_anti").select(*templates.columns)
