"""Quality rules as a short-circuit cascade.

Every rule has a measure (vectorised over whole texts) and a rejection test. ``rule_order`` takes all
measures of the first ``SAMPLE`` documents, times them, and orders the rules greedily: next comes the rule
with the most rejections per second among the sample's documents that still stand. The cascade then takes a
measure only of documents that no earlier rule has rejected. The order changes the cost alone: a
document is kept if no rule rejects it. ``rules_run`` says how many rules each document met.

Where the counts of the base rules are wanted for every document (``quality_report``), those are taken of
all, and the cascade runs over the other rules for documents that the base rules leave.

Defined results: a null text counts as empty and is rejected by ``few_words``; texts are read whole,
whatever their length; repeated rows are judged one by one; an empty table gives an empty result;
columns of the input are passed through, whatever their names; an input column that has the name asked
for as result is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from partflow.llm.shared import fresh, tidy
from partflow.llm.words import join_hashes, ranges, row_index, run_rank, slices, span_hashes, text_bytes, word_bounds

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
#: A letter, or any byte of a character outside ASCII.
_LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
SAMPLE = 2000

Measures = dict[str, np.ndarray]


class Texts:
    """Rows of one slice of a text column; word bounds, hashes and lines are found once, when first asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        self._bounds = self._hashes = self._lines = None

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._bounds is None:
            self._bounds = word_bounds(self.raw, self.offsets)
        return self._bounds

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.raw, *self.bounds()[:2])
        return self._hashes

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines with a word: row, start, first byte of its first word, byte after its last word."""
        if self._lines is None:
            breaks = np.flatnonzero(self.raw == 0x0A)
            ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
            starts = np.sort(np.concatenate([breaks + 1, self.offsets[:-1]]), kind="stable")
            per_row = np.searchsorted(breaks, self.offsets[1:]) - np.searchsorted(breaks, self.offsets[:-1]) + 1
            row = np.repeat(np.arange(len(self)), per_row)
            word_starts, word_ends, _ = self.bounds()
            first, after = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
            full = after > first
            # A line is compared as it stands, up to its break; its words say where its text begins and ends.
            self._lines = row[full], np.stack([starts[full], ends[full]]), word_starts[first[full]], word_ends[after[full] - 1]
        return self._lines

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, flags: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        offsets = self.offsets if offsets is None else offsets
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def subset(self, rows: np.ndarray) -> Texts:
        """Some rows, with what is already known of them."""
        sizes = np.diff(self.offsets)[rows]
        out = Texts(self.raw[ranges(self.offsets[rows], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
        if self._bounds is not None:
            starts, ends, first = self._bounds
            n = np.diff(first)[rows]
            at = ranges(first[rows], n)
            shift = np.repeat(out.offsets[:-1] - self.offsets[rows], n)
            out._bounds = starts[at] + shift, ends[at] + shift, np.concatenate([[0], np.cumsum(n)])
            if self._hashes is not None:
                out._hashes = self._hashes[at]
        return out


def count_words(t: Texts) -> Measures:
    return {"n_words": np.diff(t.bounds()[2])}


def count_word_chars(t: Texts) -> Measures:
    starts, ends, rows = t.bounds()
    lead = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80, dtype=np.int32)])
    sizes = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts], dtype=np.int64)])
    return {"word_chars": sizes[rows[1:]] - sizes[rows[:-1]]}


def count_symbols(t: Texts) -> Measures:
    return {"n_symbols": t.per_row(_SYMBOL[t.raw])}


def count_digits(t: Texts) -> Measures:
    return {"n_digits": t.per_row(_DIGIT[t.raw])} | count_word_chars(t)


def count_lines(t: Texts) -> Measures:
    row, (starts, ends), _, _ = t.lines()
    again = run_rank(span_hashes(t.raw, starts, ends), row) > 0
    return {"n_lines": np.bincount(row, minlength=len(t)), "n_dup_lines": np.bincount(row[again], minlength=len(t))}


def count_bullets(t: Texts) -> Measures:
    """Lines whose first word begins with ``-``, ``*`` or a bullet."""
    row, _, first, _ = t.lines()
    at = np.minimum(first[:, None] + np.arange(3), max(len(t.raw) - 1, 0))
    head = t.raw[at] if len(t.raw) else np.zeros((len(first), 3), np.uint8)
    bullet = np.isin(head[:, 0], list(b"-*")) | (head == np.frombuffer("•".encode(), np.uint8)).all(1)
    return {"n_lines": np.bincount(row, minlength=len(t)), "n_bullets": np.bincount(row[bullet], minlength=len(t))}


def count_ellipses(t: Texts) -> Measures:
    """Lines that end with three dots or an ellipsis."""
    row, (starts, _), _, last = t.lines()
    tail = t.raw[np.maximum(last[:, None] - 3 + np.arange(3), 0)] if len(t.raw) else np.zeros((len(last), 3), np.uint8)
    dots = ((tail == 0x2E).all(1) | (tail == np.frombuffer("…".encode(), np.uint8)).all(1)) & (last - starts >= 3)
    return {"n_lines": np.bincount(row, minlength=len(t)), "n_ellipses": np.bincount(row[dots], minlength=len(t))}


def count_letter_words(t: Texts) -> Measures:
    starts, ends, rows = t.bounds()
    sums = np.concatenate([[0], np.cumsum(_LETTER[t.raw], dtype=np.int32)])
    return {"n_letter_words": t.per_row(sums[ends] > sums[starts], rows)}


def count_top_word(t: Texts) -> Measures:
    """How often the most frequent word of each text stands in it."""
    row = row_index(t.bounds()[2])
    out = np.zeros(len(t), np.int64)
    np.maximum.at(out, row, run_rank(t.hashes(), row) + 1)
    return {"n_top_word": out}


def count_repeat_words(t: Texts, size: int = 5) -> Measures:
    rows = t.bounds()[2]
    row, n = row_index(rows), len(t)
    grams = join_hashes(t.hashes(), size)
    inside = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    g, r = grams[inside], row[inside]
    order = np.lexsort((g, r))
    same = (g[order][1:] == g[order][:-1]) & (r[order][1:] == r[order][:-1])
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(row) + size, np.int32)
    edge[inside[twice]] += 1
    edge[inside[twice] + size] -= 1
    return {"n_repeat_words": np.bincount(row[np.cumsum(edge)[: len(row)] > 0], minlength=n)}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the rule's measures (and always n_words) as arrays."""

    name: str
    measure: Callable[[Texts], Measures]
    rejects: Callable[[Measures], np.ndarray]


RULES = (
    Rule("few_words", count_words, lambda m: m["n_words"] < 10),
    Rule("repeats", count_repeat_words, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", count_symbols, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", count_word_chars, lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("line_repeats", count_lines, lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("digits", count_digits, lambda m: 2 * m["n_digits"] > m["word_chars"]),
    Rule("letter_words", count_letter_words, lambda m: 2 * m["n_letter_words"] < m["n_words"]),
    Rule("top_word", count_top_word, lambda m: 10 * m["n_top_word"] > 4 * m["n_words"]),
    Rule("bullets", count_bullets, lambda m: (m["n_lines"] >= 5) & (10 * m["n_bullets"] > 9 * m["n_lines"])),
    Rule("ellipses", count_ellipses, lambda m: (m["n_lines"] >= 5) & (10 * m["n_ellipses"] > 3 * m["n_lines"])),
)
BASE_RULES = ("few_words", "repeats")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _base(texts: Texts) -> Measures:
    found = count_words(texts) | count_word_chars(texts) | count_symbols(texts) | count_lines(texts) | count_repeat_words(texts)
    return {name: found[name] for name in BASE}


def _base_failed(m: Measures) -> np.ndarray:
    return np.logical_or.reduce([rule.rejects(m) for rule in RULES if rule.name in BASE_RULES])


def rule_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, after_base: bool = False, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """Rules by rejections per second: (name, seconds a document, share that it rejects of what still stands).

    Measured on the first ``sample`` documents that a scan meets (with ``after_base`` those of them that
    the base rules leave); the scan ends there. Only the order of the rules hangs on it.
    """
    schema = T.StructType([T.StructField("mask", T.LongType()), *(T.StructField(rule.name, T.DoubleType()) for rule in rules)])

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20) if batch.num_rows else ():
                texts = Texts(*text_bytes(part.column(0)))
                if after_base:
                    texts = texts.subset(np.flatnonzero(~_base_failed(_base(texts))))
                shared = count_words(texts)
                mask, seconds = np.zeros(len(texts), np.int64), []
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(shared | rule.measure(texts)).astype(np.int64) << k
                    seconds.append(np.full(len(texts), (time.perf_counter() - began) / max(1, len(texts))))
                yield pa.RecordBatch.from_arrays([pa.array(mask), *map(pa.array, seconds)], schema.names)

    found = docs.select(F.col(text).alias("t")).mapInArrow(tidy(timed), schema).take(sample)  # at most ``sample`` short rows
    masks = np.array([r.mask for r in found], np.int64)
    cost = {rule.name: max(1e-9, float(np.mean([r[rule.name] for r in found] or [1.0]))) for rule in rules}
    order, left = [], {rule.name: k for k, rule in enumerate(rules)}
    while left:
        hits = {name: float(np.mean(masks >> k & 1)) if len(masks) else 0.0 for name, k in left.items()}
        best = max(left, key=lambda name: (hits[name] / cost[name], -cost[name]))
        order.append((best, cost[best], hits[best]))
        masks = masks[(masks >> left.pop(best) & 1) == 0]
    return order


def cascade(docs: DataFrame, order: list[str], text: str = "text", base: bool = False, rules: tuple[Rule, ...] = RULES, result: str = "quality") -> DataFrame:
    """The input with a struct column ``result``: rejected_by, the first rule (in ``order``) that rejects the text, or null, and rules_run.

    With ``base`` the struct also holds the base counts, taken of every document, and base_failed; the
    rules of ``order`` then run over the documents that the base rules leave.
    """
    wanted = [rule.name for rule in rules if not (base and rule.name in BASE_RULES)]
    if sorted(order) != sorted(wanted):
        raise ValueError(f"order must name every rule once: {sorted(wanted)}")
    by_name = {rule.name: rule for rule in rules}
    kept = [c for c in docs.columns if c != result]
    at = kept.index(text)
    fields = [T.StructField("rejected_by", T.StringType()), T.StructField("rules_run", T.IntegerType())]
    if base:
        fields += [T.StructField(m, T.LongType()) for m in BASE] + [T.StructField("base_failed", T.BooleanType())]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(result, T.StructType(fields))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text) if batch.num_rows else ():
                texts, values = Texts(*text_bytes(part.column(at))), []
                verdict, run = np.full(part.num_rows, -1), np.zeros(part.num_rows, np.int32)
                standing = np.arange(part.num_rows)
                if base:
                    counts = _base(texts)
                    failed = _base_failed(counts)
                    values = [*(pa.array(counts[m], pa.int64()) for m in BASE), pa.array(failed)]
                    standing = np.flatnonzero(~failed)
                    texts = texts.subset(standing)
                for k, name in enumerate(order):
                    if not len(standing):
                        break
                    rejected = by_name[name].rejects(count_words(texts) | by_name[name].measure(texts))
                    run[standing] += 1
                    verdict[standing[rejected]] = k
                    if rejected.any():
                        texts, standing = texts.subset(np.flatnonzero(~rejected)), standing[~rejected]
                names = pa.array([order[k] if k >= 0 else None for k in verdict], pa.string())
                out = pa.StructArray.from_arrays([names, pa.array(run), *values], [f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*kept, result])

    return docs.select(*kept).mapInArrow(tidy(judge), schema)


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order, verdict = [name for name, _, _ in rule_order(docs, text)], fresh("quality", docs.columns)
    judged = cascade(docs, order, text, result=verdict)
    return judged.where(F.col(verdict)["rejected_by"].isNull()).select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, rejected_by and rules_run (null and 0 where the base rules reject) for every row."""
    docs = docs.select("doc_id", "text")
    rules = tuple(rule for rule in RULES if rule.name not in BASE_RULES)
    order = [name for name, _, _ in rule_order(docs, rules=rules, after_base=True)]
    q = F.col("quality")
    kept = ~q["base_failed"] & q["rejected_by"].isNull()
    return cascade(docs, order, base=True).select("doc_id", *(q[m].alias(m) for m in BASE), q["base_failed"].alias("base_failed"), kept.alias("kept"), q["rejected_by"].alias("rejected_by"), q["rules_run"].alias("rules_run"))
