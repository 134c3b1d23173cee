"""Column functions over part numbers, names and document text.

Word boundaries are ASCII: Java's own are Unicode-aware, so they are spelled out as look-arounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Part-number formats, brand names, appliance types, label patterns.
PART_NUMBER_FORMATS = (
    r"WP[A-Z]?\d{6,12}",
    r"AP\d{7,10}",
    r"PS\d{7,11}",
    r"DC\d{2}-\d{4,6}[A-Z]?",
    r"WR\d{2}[A-Z]\d{4,6}",
    r"WB\d{2}[A-Z]\d{4,6}",
    r"WH\d{2}[A-Z]\d{4,6}",
    r"WE\d{2}[A-Z]\d{4,6}",
    r"DE\d{2}[A-Z]\d{4,6}",
    r"DD\d{2}-\d{5,8}[A-Z]?",
    r"W\d{8,10}",
    r"EAP\d{6,10}",
    r"AH\d{6,10}",
    r"\d{6,8}[A-Z]{1,2}",
)
MENTION_FORMATS = r"WP[A-Z]?\d{5,}|W\d{7,}|WB\d+X\d+|\d{7,10}|[A-Z]{2,3}\d{6,}"
BRANDS = ("whirlpool", "kenmore", "ge", "samsung", "lg", "maytag", "frigidaire", "bosch", "kitchenaid", "amana", "hotpoint", "electrolux", "haier", "hisense")
LABEL_BRANDS = (*BRANDS, "insignia")
APPLIANCE_TYPES = {
    "refrigerator": "refrigerator", "fridge": "refrigerator", "freezer": "freezer", "washer": "washer", "washing machine": "washer", "dryer": "dryer",
    "dishwasher": "dishwasher", "range": "range", "stove": "range", "oven": "range", "cooktop": "range", "microwave": "microwave",
    "air conditioner": "hvac", "heat pump": "hvac", "furnace": "hvac", "hvac": "hvac",
}
_VALUE = r"([A-Z0-9][\w\-./]{3,30})"
MODEL_LABELS = (rf"model\s*(?:#|no\.?|number)?[\s:]*{_VALUE}", rf"mod(?:el)?\.?\s*(?:#|no\.?)?[\s:]*{_VALUE}", rf"m/n[\s:]*{_VALUE}")
SERIAL_LABELS = (rf"serial\s*(?:#|no\.?|number)?[\s:]*{_VALUE}", rf"ser(?:ial)?\.?\s*(?:#|no\.?)?[\s:]*{_VALUE}", rf"s/n[\s:]*{_VALUE}")
PART_LABELS = (rf"part\s*(?:#|no\.?|number)?[\s:]*{_VALUE}", rf"p/n[\s:]*{_VALUE}", rf"replacement\s*(?:#|no\.?)?[\s:]*{_VALUE}", rf"item\s*(?:#|no\.?)?[\s:]*{_VALUE}")
PART_SHAPES = (r"WP[A-Z]?\d{6,12}", r"AP\d{7,10}", r"PS\d{7,11}")
SECTION_MARKERS = (r"items ordered", r"order\s*#", r"shipping\s*&\s*handling", r"invoice", r"order number", r"subtotal", r"grand total", r"tracking", r"ship to", r"sold by")
STREET_WORDS = "St|Ave|Rd|Blvd|Dr|Ln|Ct|Way|Pl|Cir|Street|Avenue|Road|Drive|Lane|Boulevard"

_EDGES = " \t\n\x0b\f\r\u00a0\ufeff"


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(_EDGES))  # from both ends; a pattern would test every character of a long text


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it, and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_part_number(c: Column) -> Column:
    """Upper case, without dashes, dots, white space and number signs."""
    return F.regexp_replace(F.upper(c), r"[-.\s\u00A0#]", "")


def clean_raw_number(c: Column) -> Column:
    """As typed, trimmed and without leading number signs."""
    return F.regexp_replace(trim_all(c), "^#+", "")


def find_part_numbers(c: Column) -> Column:
    """Distinct upper-case part numbers in order of first appearance, ties in the order of the formats."""

    def hits(k: int, shape: str) -> Column:
        found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?i){B0}({shape}){B1}"), F.lit(1)), F.upper))
        at = lambda x: F.regexp_instr(c, F.concat(F.lit(f"(?i){B0}"), x, F.lit(B1)))
        return F.transform(found, lambda x: F.struct(at(x).alias("at"), F.lit(k).alias("k"), x.alias("pn")))

    every = F.concat(*(hits(k, shape) for k, shape in enumerate(PART_NUMBER_FORMATS)))

    def ordered(found: Column) -> Column:
        names = F.transform(found, lambda e: e["pn"])
        first = F.filter(found, lambda e, i: F.array_position(names, e["pn"]) == i + 1)
        return F.transform(F.array_sort(first), lambda e: e["pn"])

    # One pass tells most texts that no format occurs in them; the formats are then tried one by one.
    some = c.rlike(f"(?i){B0}(?:{'|'.join(PART_NUMBER_FORMATS)}){B1}")
    return F.when(some, let(every, ordered)).when(c.isNotNull(), F.array().cast("array<string>"))


def mine_mentions(c: Column) -> Column:
    """Normalised part numbers mentioned in a text, catalogue numbers left out; repeats stay."""
    found = F.regexp_extract_all(c, F.lit(f"(?i){B0}({MENTION_FORMATS}){B1}"), F.lit(1))
    return F.filter(F.transform(found, normalize_part_number), lambda m: ~m.rlike(r"(?i)^(?:AP|PS|EA)\d+$"))


def _hit(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def find_brand(c: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """The first brand name in the text, in lower case, or null."""
    return F.lower(_hit(c, f"(?i){B0}({'|'.join(brands)}){B1}"))


def classify_relationship(snippet: Column, part_number: Column) -> Column:
    """How the part stands to what a snippet mentions: replaced_by, replaces or compatible."""
    low = F.lower(snippet)
    replaces, own = F.locate("replaces", low), F.instr(low, F.lower(part_number))
    return (
        F.when(F.locate("replaced by", low) > 0, "replaced_by")
        .when((replaces > 0) & (own > 0) & (own < replaces), "replaces")
        .when(replaces > 0, "replaced_by")
        .otherwise("compatible")
    )


def label_fields(c: Column) -> Column:
    """Model, serial, brand and appliance type read from a label."""
    kind = F.lower(_hit(c, f"(?i){B0}({'|'.join(APPLIANCE_TYPES)}){B1}"))
    types = F.create_map(*(F.lit(x) for pair in APPLIANCE_TYPES.items() for x in pair))
    return F.struct(
        F.coalesce(*(_hit(c, f"(?i){p}") for p in MODEL_LABELS)).alias("model_number"), F.coalesce(*(_hit(c, f"(?i){p}") for p in SERIAL_LABELS)).alias("serial_number"),
        find_brand(c, LABEL_BRANDS).alias("brand"), F.try_element_at(types, kind).alias("appliance_type"),
    )


def label_part_number(c: Column) -> Column:
    """The part number of a label: after a label word, else by its shape."""
    shapes = [_hit(c, f"(?i){B0}({p}){B1}") for p in PART_SHAPES]
    return F.coalesce(*(_hit(c, f"(?i){p}") for p in PART_LABELS), *shapes, _hit(c, rf"{B0}(\d{{5,8}}[A-Z]?){B1}"))


def layout_type(c: Column) -> Column:
    """tab-delimited, n-of, space-aligned or labeled."""
    tabbed = F.size(F.filter(F.split(c, "\n"), lambda x: F.size(F.split(x, "\t")) >= 4)) >= 2
    heads = (r"quantity\s{2,}item\s*name", r"item\s*#?\s{2,}description", r"part\s*(?:number|#)\s{2,}", r"qty\s{2,}.*price")
    aligned = F.lit(False)
    for h in heads:
        aligned |= c.rlike(f"(?i){h}")
    return F.when(tabbed, "tab-delimited").when(c.rlike(r"(?i)\d+\s+of:"), "n-of").when(aligned, "space-aligned").otherwise("labeled")


def clean_markup(c: Column) -> Column:
    """Text without tags, entities, headings and links; null when under 20 characters are left."""
    for pattern, to in ((r"<[^>]+>", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"(?m)^#+\s*", ""), (r"\[.*?\]\(.*?\)", ""), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    c = trim_all(c)
    return F.when(F.char_length(c) >= 20, c)


def redact_text(c: Column, max_chars: int = 8000) -> Column:
    """E-mail, phone, street address and card ending masked, white space collapsed, cut."""
    c = F.regexp_replace(c, r"[\w.-]+@[\w.-]+\.\w{2,}", "[EMAIL]")
    c = F.regexp_replace(c, rf"{B0}(?!\d{{3}}-\d{{7}}-\d{{7}})\d{{3}}[-.]?\d{{3}}[-.]?\d{{4}}{B1}", "[PHONE]")
    c = F.regexp_replace(c, rf"(?i){B0}\d+\s+[A-Z][a-z]+\s+({STREET_WORDS}){B1}[^,]*", "[ADDRESS]")
    c = F.regexp_replace(c, r"(?i)ending in \d{4}", "ending in [XXXX]")
    return F.substring(trim_all(F.regexp_replace(c, r"[\s\u00A0]+", " ")), 1, max_chars)


def section_fingerprint(c: Column) -> Column:
    """12 hex digits of the set of section markers in a text."""
    found = F.array_sort(F.filter(F.array(*(F.when(c.rlike(f"(?i){m}"), F.lit(m)) for m in SECTION_MARKERS)), lambda x: x.isNotNull()))
    return F.substring(F.sha2(F.array_join(found, "|"), 256), 1, 12)


def vendor_key(domains: Column, keywords: Column) -> Column:
    """The first domain, else the first keyword as a slug, else unknown."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.try_element_at(keywords, F.lit(1))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.size(domains) > 0, F.lower(F.try_element_at(domains, F.lit(1)))).otherwise(F.coalesce(slug, F.lit("unknown")))


def normalize_domain(c: Column) -> Column:
    """Lower case, without a leading dot and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\.", ""), r"^www\.", "")


def fuzzy_match(a: Column, b: Column) -> Column:
    """Whether over 0.7 of the longer name's length is covered by characters of the shorter that it contains."""
    a, b = trim_all(F.lower(a)), trim_all(F.lower(b))
    shorter, longer = F.when(F.char_length(a) <= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) > F.char_length(b), a).otherwise(b)
    seen = F.size(F.filter(F.split(shorter, ""), lambda x: (x != "") & F.contains(longer, x)))
    return (a == b) | (seen / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)) > 0.7)


def round2(c: Column) -> Column:
    """Cents, halves upwards; numbers from 2^53 hundredths on, which have no fraction, do not pass through a whole number of 64 bits."""
    return let(c * 100 + 0.5, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x)).otherwise(x) / 100)


def parse_qty(c: Column) -> Column:
    """A leading whole number, or 1 where there is none or it is 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(1))


def parse_price(c: Column) -> Column:
    """Digits and dots read as a number; null where that is nothing or 0."""
    digits = F.regexp_extract(F.regexp_replace(c, "[^0-9.]", ""), r"^(\d*\.?\d*)", 1)
    return F.nullif(digits.try_cast("double"), F.lit(0.0))


def line_total(unit: Column, ship: Column, tax: Column) -> Column:
    """Unit price, shipping and tax together; what is missing counts 0."""
    return F.coalesce(unit, F.lit(0.0)) + F.coalesce(ship, F.lit(0.0)) + F.coalesce(tax, F.lit(0.0))


def repair_tracking(tracking: Column, text: Column) -> Column:
    """A tracking number of 8 or more digits, with the 1-3 digits of the line after its first line appended."""

    def repaired(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.contains(x, tracking)), F.lit(True))
        tail = let(at, lambda n: F.when(n > 0, trim_all(F.get(lines, n.cast("int")))))
        return let(tail, lambda x: F.when(x.rlike(r"^\d{1,3}$"), F.concat(tracking, x)).otherwise(tracking))

    # Lines are made only where the text holds the number at all.
    return F.when(tracking.rlike(r"^\d{8,}$") & F.contains(text, tracking), let(F.split(text, "\n"), repaired)).otherwise(tracking)


TRACKING_FORMATS = (r"^\d{10,}$", r"^[A-Z]{2}\d{9}[A-Z]{2}$", r"^1Z[A-Z0-9]{16}$", r"^\d{4}\s?\d{4}\s?\d{4}\s?\d{4}")
BAD_COURIERS = ("shipped", "pending", "processing", "completed", "paid", "n/a", "none", "visa", "cash")
BAD_BRANDS = ("svce", "service", "assy", "assembly", "kit", "oem", "new", "used", "repl")


def valid_tracking(tracking: Column, order_number: Column, part_numbers: Column) -> Column:
    """The tracking number if it has a known format and is no order or part number, else null."""

    def valid(t: Column) -> Column:
        known = F.lit(False)
        for f in TRACKING_FORMATS:
            known |= t.rlike(f)
        return known & ~(F.coalesce(t == order_number, F.lit(False)) | F.coalesce(F.array_contains(part_numbers, t), F.lit(False)))

    return let(tracking, lambda x: F.when(let(trim_all(x), valid), x))


def valid_word(c: Column, bad: tuple[str, ...]) -> Column:
    """The word unless it is one of ``bad`` or shorter than 2 characters."""
    t = F.lower(trim_all(c))
    return F.when(~t.isin(*bad) & (F.char_length(t) >= 2), c)


EVENT_LABELS = {"added": "Added", "used": "Used", "sold": "Sold", "ebay_sold": "eBay sale", "adjusted": "Adjusted"}


def event_label(c: Column) -> Column:
    """The display name of an event type; unknown types read Adjusted."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in EVENT_LABELS.items() for x in pair)), c), F.lit("Adjusted"))


def relative_age(c: Column, now: Column) -> Column:
    """How long ago: just now, minutes, hours, days under a week, else the day."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago")))
        .when(days < 7, F.concat(days, F.lit("d ago"))).otherwise(F.date_format(c, "MMM d"))
    )


def expiry_warning(expiry: Column, status: Column, count: Column, now: Column) -> Column:
    """The warning for a domain's expiry, or null."""
    seconds = (F.unix_micros(expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
    days = F.ceil(seconds / 86400)
    word = F.when(days > 1, " days").otherwise(" day")
    return (
        F.when(seconds < 0, "Auth cookies may have expired").when(seconds < 86400, "Auth cookies expire within 24 hours")
        .when(seconds < 7 * 86400, F.concat(F.lit("Auth cookies expire in "), days, word))
        .when(expiry.isNull() & (status == "active") & (count > 0), "No expiry data (use cookies.txt or JSON format for expiry tracking)")
    )


def literal_fraction(c: Column) -> Column:
    """The part of a pattern's characters that stand for themselves (letters and digits outside escapes)."""
    bare = F.regexp_replace(c, r"\\[dDsSwWbBtnrfv.+*?^$|{}()\[\]]", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"[+*?.^$|{}()\[\]\\]", ""), "[^a-zA-Z0-9]", "")
    return F.when(F.char_length(c) > 0, F.char_length(plain) / F.char_length(c)).otherwise(0.0)


def url_admissible(c: Column) -> Column:
    """https, and a host that is neither local nor an IP literal."""
    host = F.lower(F.regexp_extract(c, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    local = (bare == "localhost") | bare.endswith(".local") | bare.endswith(".internal")
    literal = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(bare, F.lit(":"))
    return F.coalesce(c.rlike("(?i)^https://") & (bare != "") & ~local & ~literal, F.lit(False))


def is_private_ip(c: Column) -> Column:
    """Whether a resolved address is private, local or reserved."""
    mapped = F.regexp_extract(c, r"(?i)^::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    ip = F.when(mapped != "", mapped).otherwise(c)
    second = F.get(F.split(ip, r"\."), F.lit(1)).try_cast("int")
    out = (ip == "::1") | (ip == "::")
    for start in ("0.", "10.", "127.", "169.254.", "192.168.", "198.18.", "198.19.", "240.", "fc", "fd", "fe80"):
        out |= ip.startswith(start)
    out |= ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False))
    return out | (ip.startswith("100.") & F.coalesce(second.between(64, 127), F.lit(False)))
