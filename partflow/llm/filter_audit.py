"""How five text filters act on each other, for every order in which they can be applied.

Each document fails some set of the filters. Per part, the documents are counted by that set; from it follow, for all
32 coalitions of filters, how many documents (and how many good and toxic ones) the coalition removes. The removal of a
step is the difference of two coalitions: the filters up to it and those before it.

A filter's Shapley value is found as a constrained least squares fit: of all additive values that give the whole
coalition what it removes, those with the least squared error over the other coalitions, each weighted by the Shapley
kernel. The normal equations with their constraint do not depend on the counts, so ``shapley_weights`` solves them once,
in rationals, for every coalition as the only one that removes anything; a value is then a sum over the coalitions with
whole-number weights, when all orders are summed. No order is replayed and nothing is rounded.

Filters (words are maximal runs of ``[^\\x20\\x09-\\x0D]``): A under 200 words; B fewer than half of the words distinct;
C more than 2 % capitals A to Z; D holds any of ``#$%&*|``; E equal to the text of a row with a smaller doc_id, anywhere
in the table. Texts meet by their SHA-256 alone.

Defined results: a null text is empty; an empty text fails A, and E where another empty one has a smaller doc_id; a row
without doc_id never fails E and makes no other row fail it; rows that repeat a doc_id count each and do not make each
other fail E; a null part is the empty string; a document without labels is neither good nor toxic, one labelled more than
once is what any of its labels says; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _solved(rows: list[list[Fraction]], n: int) -> list[list[Fraction]]:
    """The right-hand sides of ``n`` equations after Gauss-Jordan elimination."""
    rows = [r[:] for r in rows]
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                factor = rows[k][i]
                rows[k] = [x - factor * y for x, y in zip(rows[k], rows[i])]
    return [r[n:] for r in rows]


@cache
def shapley_weights(n: int) -> list[list[int]]:
    """For each of ``n`` filters, the weight of every coalition's removal (bit i of its number: filter i) in the filter's
    removals summed over all orders.

    Minimise the sum over proper coalitions S of k(S) * (v(S) - sum of x_i in S) ** 2 under: sum of all x_i = v(all), with
    the kernel k(S) = (n - 1) / (C(n, |S|) * |S| * (n - |S|)). One multiplier joins the n unknowns.
    """
    full = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, full)}
    equations = []
    for i in range(n):
        left = [sum((k for s, k in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(full + 1)]
        equations.append([*left, Fraction(1), *right])
    equations.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == full) for s in range(full + 1)])
    weights = [[x * factorial(n) for x in row] for row in _solved(equations, n + 1)[:n]]
    assert all(x.denominator == 1 for row in weights for x in row)
    return [[int(x) for x in row] for row in weights]


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, fails) of every row; bit i of ``fails`` is set where filter i is failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    slim = slim.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    capitals = F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    own = [F.size("words") < 200, 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"), 100 * capitals > 2 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own)), F.lit(0))
    slim = slim.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.alias("own"))
    # the smallest doc_id of each text; a row holds it or not, so copies of a text never meet in one task
    first = slim.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    later = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return slim.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("fails"))


def _steps() -> list[dict[str, str | int]]:
    """Of every step of every order: its filter i, and the coalitions a before and b after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "i": i, "a": before, "b": before | 1 << i})
            before |= 1 << i
    return out


def coalitions(marked: DataFrame, n: int) -> DataFrame:
    """Per part, arrays over all coalitions: documents, good and toxic ones that each removes; ``docs`` counts all.

    ``marked`` holds part, fails, good and toxic (0 or 1). A part has at most 2 ** n cells before they are gathered.
    """
    cells = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.sum("n").alias("docs"), F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))

    def removed(field: str) -> Column:
        each = lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda total, c: total + F.when(c["fails"].bitwiseAND(s) != 0, c[field]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), each).alias(field)

    return parts.select("part", "docs", removed("n"), removed("good"), removed("toxic"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: counts of what the step keeps and removes, and its filter's Shapley sum."""
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = failures(docs, text, doc_id, part).join(known, "doc_id", "left").select("part", "fails", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    weights = F.from_json(F.lit(json.dumps(shapley_weights(n))), "array<array<bigint>>")
    shapley = F.transform(weights, lambda row: F.aggregate(F.zip_with(row, "n", lambda w, v: w * v), F.lit(0).cast("long"), lambda total, x: total + x))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, i int, a int, b int>>")
    rows = coalitions(marked, n).withColumn("shapley", shapley).select("*", F.explode(steps).alias("s")).select("*", "s.*")
    at = lambda field, index: F.get(field, index)
    gone = {field: at(field, F.col("b")) - at(field, F.col("a")) for field in ("n", "good", "toxic")}
    alone = F.pow(F.lit(2), F.col("i")).cast("int")
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - at("n", F.col("b"))).alias("kept"), gone["n"].alias("removed"), (at("n", alone) - gone["n"]).alias("redundant"),
        (at("n", F.lit(full)) - at("n", F.lit(full) - alone)).alias("unique_fails"), gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), at("shapley", F.col("i")).alias("shapley"),
    )
