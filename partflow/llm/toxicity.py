"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its lower-case terms, hashed to ``BUCKETS``: runs of letters and digits, and their
beginnings of ``STEMS`` bytes, since in inflected languages a stem tells more than its forms. The model
adds a weight for each term and, for each pair of terms, the inner product of their factors, so a pair
such as an insult beside a group mention can count for more than its parts, and can tell where neither
part does.

A long text holds thousands of terms, whose small random weights and factors would add up. No term is
screened by itself; instead weights are fitted by FTRL with an L1 penalty that grows with the root of the
rows, and factors in two passes: first every term gets some, then only those terms keep factors whose
norm stands out among all by ``STAND_OUT`` (robust) standard deviations, or reaches 1. A term that no other makes telling keeps a small norm.

It is fitted on at most ``max_rows`` labelled rows, chosen by hash, and ``MAX_TERMS`` terms of them (the
bounds of the training sample, which one task holds), and is a fixed number of bytes; scoring is one pass
over whole texts.

Defined results: null and empty texts get the score of a text without terms; repeated rows are scored
one by one; labels without a value, or of unknown documents, are left out; without any usable label
every score is 0; a null doc_id is never held out; an empty table gives an empty result; columns of any
name are kept by ``score_toxicity``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from partflow.llm.shared import fresh
from partflow.llm.words import mix, slices, span_hashes, text_bytes, word_bounds

BUCKETS = 1 << 18
FACTORS = 4
MAX_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8)
LEAST = 5
MAX_TERMS = 40_000_000
STAND_OUT = 15.0
_TERM_END = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct hashed term, by row."""
    raw, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, rows = word_bounds(raw, offsets, _TERM_END)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows)) * BUCKETS
    both = [row + (span_hashes(raw, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)]
    for size in STEMS:
        long = ends - starts > size
        stem = mix(span_hashes(raw, starts[long], starts[long] + size))
        both.append(row[long] + (stem % np.uint64(BUCKETS)).astype(np.int64))
    both = np.unique(np.concatenate(both))
    return both // BUCKETS, both % BUCKETS


class FactorizationMachine:
    """Bias, term weights and term factors; terms outside the training sample count nothing."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self.known = (weights != 0) | factors.any(1)

    def margin(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        use = self.known[term]
        row, term = row[use], term[use]
        out = self.bias + np.bincount(row, self.weights[term], n)
        for v in self.factors.T:
            x = v[term]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, term, n), -50, 50)))


def _passes(terms: list[np.ndarray], labels: np.ndarray, size: int, paired: np.ndarray, epochs: int, l1: float, rng: np.random.Generator, batch: int = 32, rate: float = 0.05, decay: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (FTRL-proximal), factors of the ``paired`` terms (AdaGrad) and bias, on the logistic loss."""
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    v, gv = rng.normal(0, 0.02, (size, FACTORS)) * paired[:, None], np.full((size, FACTORS), 1e-2)
    share = labels.mean() if len(labels) else 0.0
    b, gb = float(np.log((share + 1e-3) / (1 - share + 1e-3))), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(terms))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            rows = len(at)
            term = np.concatenate([terms[i] for i in at])
            row = np.repeat(np.arange(rows), [len(terms[i]) for i in at])
            pair = np.flatnonzero(paired[term])
            pair_row, pair_term = row[pair], term[pair]
            x = v[pair_term]
            sums = np.stack([np.bincount(pair_row, c, rows) for c in x.T], 1)
            squares = np.stack([np.bincount(pair_row, c * c, rows) for c in x.T], 1)
            y = b + np.bincount(row, w[term], rows) + 0.5 * (sums**2 - squares).sum(1)
            g = 1 / (1 + np.exp(-np.clip(y, -50, 50))) - labels[at]
            own, where = np.unique(term, return_inverse=True)
            dw = np.bincount(where, g[row], len(own))
            root = np.sqrt(n[own] + dw**2)
            z[own] += dw - (root - np.sqrt(n[own])) * w[own]
            n[own] += dw**2
            w[own] = np.where(np.abs(z[own]) > l1, -(z[own] - np.sign(z[own]) * l1) / (2 + root), 0)
            own, where = np.unique(pair_term, return_inverse=True)
            slope = g[pair_row][:, None] * (sums[pair_row] - x)
            dv = np.stack([np.bincount(where, c, len(own)) for c in slope.T], 1) + decay * v[own]
            gv[own] += dv**2
            v[own] -= rate * dv / np.sqrt(gv[own])
            gb += g.sum() ** 2
            b -= 0.1 * g.sum() / np.sqrt(gb)
    return w, v, b


def fit(terms: list[np.ndarray], labels: np.ndarray, passes: int = 50_000, least: int = LEAST, stand_out: float = STAND_OUT, seed: int = 11) -> FactorizationMachine:
    """The machine for term sets and labels (0 or 1); terms in fewer than ``least`` rows are left out.

    About ``passes`` rows are looked at in the second pass (4 to 20 rounds), half as many in the first.
    """
    rng = np.random.default_rng(seed)
    df = np.zeros(BUCKETS, np.int64)
    for t in terms:
        df[t] += 1
    used = np.flatnonzero(df >= least)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    terms = [x[x >= 0] for x in (place[t] for t in terms)]
    weights, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    if not len(used):
        share = labels.mean() if len(labels) else 0.0
        return FactorizationMachine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), weights, factors)
    epochs, l1 = int(np.clip(passes // max(1, len(terms)), 4, 20)), 0.156 * np.sqrt(len(terms))
    _, v, _ = _passes(terms, labels, len(used), np.ones(len(used), bool), (epochs + 1) // 2, l1, rng)
    norm = np.linalg.norm(v, axis=1)
    middle = np.median(norm)
    paired = norm > min(1.0, middle + stand_out * 1.4826 * np.median(np.abs(norm - middle)))  # 1 is a strong factor among any
    w, v, b = _passes(terms, labels, len(used), paired, epochs, l1, rng)
    weights[used], factors[used] = w, v
    return FactorizationMachine(b, weights, factors)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept away from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    wanted = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", F.xxhash64("doc_id", "text").alias("h"), "text")  # at most max_rows ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                row, term = term_sets(part.column(2))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))], ["y", "h", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, terms, held = [], [], 0
        for batch in batches:
            for value, found in zip(batch.column(0).to_pylist(), batch.column(2)):
                if held <= MAX_TERMS:
                    y.append(value)
                    terms.append(np.array(found.values, np.int32))
                    held += len(terms[-1])
        model = fit(terms, np.array(y, float))
        known = np.flatnonzero(model.known)
        yield pa.RecordBatch.from_pydict({"b": [model.bias], "k": [known.astype("<i4").tobytes()], "w": [model.weights[known].astype("<f4").tobytes()], "v": [model.factors[known].astype("<f4").tobytes()]})

    # The sample is bounded, so one task may fit it; what comes back is at most BUCKETS weights.
    got = wanted.mapInArrow(sets, "y double, h long, terms array<int>").repartition(1).sortWithinPartitions("h", "y").mapInArrow(learn, "b double, k binary, w binary, v binary").first()
    weights, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    if got is None:
        return FactorizationMachine(-50.0, weights, factors)
    known = np.frombuffer(got.k, "<i4")
    weights[known], factors[known] = np.frombuffer(got.w, "<f4"), np.frombuffer(got.v, "<f4").reshape(-1, FACTORS)
    return FactorizationMachine(got.b if len(known) else -50.0, weights, factors)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, keep: tuple[str, ...] = ("doc_id",), text: str = "text", result: str = "score") -> DataFrame:
    """The ``keep`` columns and the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))  # fixed size

    name = fresh("text", [*keep, result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        for batch in batches:
            for part in slices(batch, name) if batch.num_rows else ():
                row, term = term_sets(part.column(part.num_columns - 1))
                score = machine.score(row, term, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score, pa.float64())], names=[*keep, result])

    source = docs.select(*keep, F.col(text).alias(name))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, {result} double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) for every document."""
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
