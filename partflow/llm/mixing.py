"""Mixing to target weights by soft membership, on DataFrame and SQL functions only.

1. A classifier is fitted on labelled rows (at most ``MAX_ROWS``, chosen by hash): naive Bayes over
   hashed lower-case words, of which only those with a clear difference between classes count.
2. Every document gets posteriors p over the domains and its number of tokens n: the pieces that a byte-pair
   tokenizer's pre-tokenizer cuts it into, counted by one pattern, so that no Python runs.
3. Rates r >= 0 are fitted so that the expected domain totals sum(r * n * p) meet the targets: projected
   gradient on the least squares, from r = 1, the step scaled by the Gram matrix of the documents that
   still have a positive rate. A step is r := max(0, r - p . g) with one vector g for all documents, so
   the rates are a short fold over the list of steps, and a round needs one aggregation of domain-sized
   rows. Nothing larger than domains x domains reaches the driver.
4. A document occurs floor(r + u) times, u in [0, 1) being a hash of it.

The default targets follow the domains' own totals to the power ``ALPHA``, scaled so that no domain gets
less than it has: smaller domains are repeated, nothing is thrown away for its domain's sake.

Defined results: null and empty texts have 0 tokens, the prior as posterior, and add nothing to totals;
labels that are null or of unknown documents are left out; without labels all documents are of the first
domain; a target for an empty domain is ignored; repeated rows are separate documents; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from partflow.llm.shared import stored

BUCKETS = 1 << 15
MAX_ROWS = 6000
DOMAINS = ("clean", "low", "toxic")
ALPHA = 0.8
#: The cuts of a byte-pair tokenizer before its merges: runs of letters, digits, other signs (each with a space before) and white space.
TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROUNDS = 25


def label_domain() -> Column:
    """The domain of a row of ``labels``: toxic, else low quality, else clean."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _tokens(text: Column) -> Column:
    """How many tokens a byte-pair tokenizer's pre-tokenizer cuts a text into."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def _terms(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row: log priors (prior) and for each domain but the first the log odds of every bucket (odds1, odds2, ...).

    ``labelled`` has doc_id and domain (0, 1, ...).
    """
    k = len(DOMAINS)
    sample = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "domain")), "doc_id")  # at most max_rows ids
    rows = rows.select("domain", F.array_distinct(_terms(_words(F.col("text")))).alias("terms"))
    size = [float(x) for x in rows.agg(*(F.count_if(F.col("domain") == i).alias(f"n{i}") for i in range(k))).first()]
    seen = rows.select("domain", F.explode("terms").alias("b")).groupBy("b").agg(*(F.count_if(F.col("domain") == i).cast("double").alias(f"c{i}") for i in range(k)))
    grid = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(seen, "b", "left")

    def odds(i: int) -> Column:
        ci, c0 = F.coalesce(f"c{i}", F.lit(0.0)), F.coalesce("c0", F.lit(0.0))
        value = F.log((ci + 0.5) / (size[i] + 1)) - F.log((c0 + 0.5) / (size[0] + 1))
        clear = F.abs(value) > 4 * F.sqrt(1 / (ci + 0.5) + 1 / (c0 + 0.5))
        return F.when(clear, value).otherwise(0.0)

    ordered = grid.select("b", *(odds(i).alias(f"o{i}") for i in range(1, k)))
    lists = [F.array_sort(F.collect_list(F.struct("b", F.col(f"o{i}").alias("o"))))["o"].alias(f"odds{i}") for i in range(1, k)]
    shares = [(n + (1.0 if i == 0 else 0.01)) / (sum(size) + 1) for i, n in enumerate(size)]
    prior = F.array(*(F.lit(math.log(x)) for x in shares))
    return ordered.agg(F.first(prior).alias("prior"), *lists)


def memberships(docs: DataFrame, model: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_tokens (long) and p (posterior of each domain)."""
    k = len(DOMAINS)
    words = _words(F.col("text"))
    rows = docs.select(*keep, _tokens(F.col("text")).alias("n_tokens"), _terms(words).alias("_terms"))

    prior = model.select("prior").scalar()

    def summed(i: int) -> Column:
        return F.aggregate("_terms", F.lit(0.0), lambda s, b: s + F.get(f"_odds{i}", b))

    rows = rows.withColumns({f"_odds{i}": model.select(f"odds{i}").scalar() for i in range(1, k)})
    sums = [F.lit(0.0), *(summed(i) for i in range(1, k))]
    rows = rows.select(*keep, "n_tokens", *(x.alias(f"_s{i}") for i, x in enumerate(sums)))
    logits = [F.col(f"_s{i}") + F.get(prior, F.lit(i)) for i in range(k)]
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = reduce(lambda a, b: a + b, parts)
    return rows.select(*keep, "n_tokens", F.array(*(x / total for x in parts)).alias("p"))


def rate(steps: list[list[float]]) -> Column:
    """The rate of a row with posteriors ``p`` after the given steps."""
    if not steps:
        return F.lit(1.0)
    listed = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))

    def step(r: Column, g: Column) -> Column:
        return F.greatest(F.lit(0.0), r - reduce(lambda a, b: a + b, (F.get("p", F.lit(i)) * F.get(g, F.lit(i)) for i in range(len(steps[0])))))

    return F.aggregate(listed, F.lit(1.0), step)


def fit_rates(members: DataFrame, weights: list[float] | None = None, total: float | None = None, rounds: int = ROUNDS, tolerance: float = 1e-6) -> tuple[list[list[float]], list[float], list[float]]:
    """(steps, targets, fitted totals) for rows of n_tokens and p.

    ``weights`` are the target shares of the domains; ``total`` the wanted number of tokens (default: the
    least that cuts no domain).
    """
    k = len(DOMAINS)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        p, r = [F.get("p", F.lit(i)) for i in range(k)], F.col("r")
        rows = members.select("n_tokens", "p", rate(steps).alias("r"))
        sums = [F.sum(r * F.col("n_tokens") * p[i]) for i in range(k)]
        gram = [F.sum(F.when(r > 0, F.col("n_tokens") * p[i] * p[j])) for i in range(k) for j in range(k)]
        got = [float(x or 0) for x in rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums + gram))).first()]
        return np.array(got[:k]), np.array(got[k:]).reshape(k, k)

    steps: list[list[float]] = []
    have, gram = totals(steps)
    if not have.any():
        return steps, have.tolist(), have.tolist()
    shares = np.array(weights, float) if weights is not None else np.where(have > 0, have, 0) ** ALPHA
    shares = np.where(have > 0, shares, 0)
    shares = shares / shares.sum()
    wanted = shares * (total if total is not None else (have[shares > 0] / shares[shares > 0]).max())
    error, scale = np.linalg.norm(have - wanted), 1.0
    for _ in range(rounds):
        if error <= tolerance * np.linalg.norm(wanted):
            break
        g = np.linalg.solve(gram + 1e-9 * np.trace(gram) * np.eye(k), have - wanted) * scale
        after, new_gram = totals([*steps, g.tolist()])
        if np.linalg.norm(after - wanted) < error:
            steps.append(g.tolist())
            have, gram, error, scale = after, new_gram, np.linalg.norm(after - wanted), min(1.0, scale * 2)
        else:
            scale /= 4
            if scale < 1e-4:
                break
    return steps, wanted.tolist(), have.tolist()


def _draw(key: Column, r: Column) -> Column:
    """How often a document occurs: the rate, rounded up or down by a hash of its id and text."""
    return F.floor(r + F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: list[float] | None = None, total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document."""
    model = stored(fit_classifier(docs, labels.select("doc_id", label_domain().alias("domain"))), "classifier")
    members = stored(memberships(docs.select("doc_id", "text", _key()), model, ["doc_id", "key"]), "members")
    steps, _, _ = fit_rates(members, weights, total)
    named = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return members.select("doc_id", "n_tokens", *named, rate(steps).alias("rate"), _draw(F.col("key"), rate(steps)).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: list[float] | None = None, total: float | None = None) -> DataFrame:
    """The documents, each as often as its rate says, with their own columns."""
    model = stored(fit_classifier(docs, labels.select("doc_id", label_domain().alias("domain"))), "classifier")
    # Written with the documents: posteriors are read as values, not worked out again for each use.
    members = stored(memberships(docs.select(F.struct(*docs.columns).alias("row"), "text", _key()), model, ["row", "key"]), "members")
    steps, _, _ = fit_rates(members.select("n_tokens", "p"), weights, total)
    rows = members.select("row", _draw(F.col("key"), rate(steps)).alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
