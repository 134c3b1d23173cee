"""External counting of the documents that hold a pair (a, b), and each document's share of the counts.

``RunWriter`` gathers pair-document records inside a task. When its buffer is full, they are sorted and spilled as one
run: per radix of ``a`` a frame sequence of zstd blocks with the pairs in order and how many of the run's documents hold
each (``heads``), and one with those documents (``body``). A pair's key holds the radix on top, then the rest of ``a``,
then ``b``, so order by key is radix by radix and side-major within it.

``count_runs`` merges the heads of each radix: a heap of the runs by the last key of the block they are in gives the
bound up to which every run's entries are at hand; those are summed and runs that are used up to their block's end read
the next. At most about ``FAN_IN`` runs meet in one task, over as many levels as it takes, and each has a pair at most
once however many documents hold it, so neither a hot pair nor a hot side grows beyond the number of runs. The last
level sees all pairs of a side together and marks those with its maximum. ``contributions`` streams the totals of a
radix past groups of runs and adds them up by document.

A task holds a buffer, or ``FAN_IN`` compressed runs with one block of each, or ``FAN_IN`` runs of one radix; the records
of one document always go to one run, which a very long text may make larger than the buffer.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from partflow.llm.shared import drop_stored, stored

RADIX_BITS = 4
BUFFER = 1_500_000
BLOCK = 1 << 13
FAN_IN = 32
RUN_FIELDS = "radix int, base long, heads binary, body binary"
_U = np.uint64


def _frames(*columns: np.ndarray) -> bytes:
    """Columns of one length in length-prefixed zstd frames of BLOCK rows: per column its type's letter and byte planes."""
    out, press = [], zstandard.ZstdCompressor(level=3)
    for lo in range(0, len(columns[0]), BLOCK):
        planes = [c[lo : lo + BLOCK].view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns]
        frame = press.compress(b"".join(planes))
        out.append(struct.pack("<II", len(frame), len(columns[0][lo : lo + BLOCK])) + frame)
    return b"".join(out)


def _blocks(data: bytes, *kinds: str) -> Iterator[list[np.ndarray]]:
    """The columns of each frame, one frame at a time."""
    at, press = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        size, n = struct.unpack_from("<II", data, at)
        raw, lo, columns = np.frombuffer(press.decompress(data[at + 8 : at + 8 + size]), np.uint8), 0, []
        for kind in map(np.dtype, kinds):
            columns.append(np.ascontiguousarray(raw[lo : lo + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
            lo += n * kind.itemsize
        yield columns
        at += 8 + size


def _whole(data: bytes, *kinds: str) -> list[np.ndarray]:
    blocks = list(_blocks(data, *kinds))
    return [np.concatenate(c) for c in zip(*blocks)] if blocks else [np.zeros(0, k) for k in kinds]


class RunWriter:
    """Sorted runs of the pair-document records of one task."""

    def __init__(self, size_a: int, size_b: int, base: int, buffer: int | None = None) -> None:
        self.bits_a, self.bits_b = max(RADIX_BITS + 1, (size_a - 1).bit_length()), max(1, (size_b - 1).bit_length())
        self.bits_doc = 64 - self.bits_a - self.bits_b
        if self.bits_doc < 20:
            raise ValueError("the two vocabularies leave no room for documents in 64 bits")
        self.base, self.docs, self.held, self.n, self.buffer = base, 0, [], 0, buffer or BUFFER

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a.astype(_U)
        swapped = (a & _U((1 << RADIX_BITS) - 1)) << _U(self.bits_a - RADIX_BITS) | a >> _U(RADIX_BITS)
        return swapped << _U(self.bits_b) | b.astype(_U)

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, docs: int) -> None:
        """Records of the next ``docs`` documents, ``doc`` counting from the first of them; records may repeat."""
        self.held.append(self.keys(a, b) << _U(self.bits_doc) | (doc + self.docs).astype(_U))
        self.docs += docs
        self.n += len(a)

    @property
    def full(self) -> bool:
        return self.n >= self.buffer or self.docs >= 1 << (self.bits_doc - 1)

    def spill(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(radix, base, heads, body) of what is held; the next document starts a new run."""
        records = np.concatenate([np.zeros(0, _U), *self.held])
        records.sort()
        self.held = []
        first = np.flatnonzero(np.concatenate([[True], records[1:] != records[:-1]])[: len(records)])
        times = np.diff(np.append(first, len(records))).astype(np.uint32)
        records = records[first]
        pair, doc = records >> _U(self.bits_doc), (records & _U((1 << self.bits_doc) - 1)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
        heads, counts = pair[at], np.diff(np.append(at, len(pair))).astype(np.int64)
        cuts = np.searchsorted(heads, np.arange(1, 1 << RADIX_BITS).astype(_U) << _U(self.bits_a - RADIX_BITS + self.bits_b))
        edges = [0, *cuts.tolist(), len(heads)]
        for radix, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if hi > lo:
                rows = slice(at[lo], at[hi] if hi < len(at) else len(pair))
                yield radix, self.base, _frames(heads[lo:hi], counts[lo:hi]), _frames(doc[rows], times[rows])
        self.base += self.docs
        self.docs = self.n = 0


def merged(runs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, summed counts) of all runs in key order, in blocks; a key stands in one block only."""
    sources = [_blocks(r, "u8", "i8") for r in runs]
    held = {i: b for i, s in enumerate(sources) if (b := next(s, None))}
    heap = [(b[0][-1], i) for i, b in held.items()]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]  # no run has entries up to here outside its block
        keys, counts = [], []
        for i, (k, c) in held.items():
            n = int(np.searchsorted(k, bound, side="right"))
            if n:
                keys.append(k[:n])
                counts.append(c[:n])
                held[i] = [k[n:], c[n:]]
        while heap and heap[0][0] == bound:
            _, i = heapq.heappop(heap)
            if block := next(sources[i], None):
                held[i] = block
                heapq.heappush(heap, (block[0][-1], i))
            else:
                del held[i]
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        yield k[first], np.add.reduceat(c, first)


def with_maxima(blocks: Iterable[tuple[np.ndarray, np.ndarray]], bits_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, counts, whether the count is its side's highest), a side's pairs never apart."""

    def closed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = k >> _U(bits_b)
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        return k, c, c == np.repeat(np.maximum.reduceat(c, first), np.diff(np.append(first, len(k))))

    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    for k, c in blocks:
        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
        cut = int(np.searchsorted(keys, keys[-1] >> _U(bits_b) << _U(bits_b)))  # the last side may go on in the next block
        if cut:
            yield closed(keys[:cut], counts[:cut])
            keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield closed(keys, counts)


def _joined(columns: list[tuple[np.ndarray, ...]], kinds: tuple[str, ...]) -> bytes:
    return _frames(*(np.concatenate([np.zeros(0, t), *c]) for t, c in zip(kinds, zip(*columns)))) if columns else b""


def count_runs(runs: DataFrame, n_runs: int, bits_b: int) -> DataFrame:
    """(radix, totals): the pairs of each radix in order with their counts and whether they are their side's highest."""
    level, spent = runs.select("radix", F.col("base").alias("run"), "heads"), []

    def part(table: pa.Table) -> pa.Table:
        made = _joined(list(merged(table.column("heads").to_pylist())), ("u8", "i8"))
        return pa.table({"radix": table.column("radix")[:1].cast(pa.int32()), "run": table.column("group")[:1].cast(pa.int64()), "heads": pa.array([made], pa.binary())})

    def last(table: pa.Table) -> pa.Table:
        made = ((k, c << 1 | best) for k, c, best in with_maxima(merged(table.column("heads").to_pylist()), bits_b))
        return pa.table({"radix": table.column("radix")[:1].cast(pa.int32()), "totals": pa.array([_joined(list(made), ("u8", "i8"))], pa.binary())})

    while n_runs > FAN_IN:
        n_runs = -(-n_runs // FAN_IN)
        grouped = level.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n_runs)))
        level = stored(grouped.groupBy("radix", "group").applyInArrow(part, "radix int, run long, heads binary"), "merged")
        spent.append(level)
    totals = stored(level.groupBy("radix").applyInArrow(last, "radix int, totals binary"), "totals")
    drop_stored(*spent)
    return totals


def contributions(runs: DataFrame, totals: DataFrame, n_runs: int) -> DataFrame:
    """(row, n_best, count_sum) of every document with records: its records whose pair is its side's highest, and the sum of
    its records' counts."""
    groups = max(1, -(-n_runs // FAN_IN))
    salted = runs.withColumn("group", F.pmod(F.xxhash64("base"), F.lit(groups)))
    copies = totals.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def add(mine: pa.Table, whole: pa.Table) -> pa.Table:
        held = []
        for base, heads, body in zip(*(mine.column(c).to_pylist() for c in ("base", "heads", "body"))):
            keys, sizes = _whole(heads, "u8", "i8")
            held.append((base, keys, sizes, np.zeros(len(keys), np.int64), body))
        for totals in whole.column("totals").to_pylist() if held else ():
            for k, c in _blocks(totals, "u8", "i8"):
                for _, keys, _, found, _ in held:
                    lo, hi = np.searchsorted(keys, k[0]), np.searchsorted(keys, k[-1], side="right")
                    found[lo:hi] = c[np.searchsorted(k, keys[lo:hi])]
        rows, best, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for base, _, sizes, found, body in held:
            doc, times = _whole(body, "u4", "u4")
            n = int(doc.max()) + 1
            each, times = np.repeat(found, sizes), times.astype(np.int64)
            b, s = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(b, doc, times * (each & 1))
            np.add.at(s, doc, times * (each >> 1))
            at = np.flatnonzero(s)
            rows.append(at + base)
            best.append(b[at])
            sums.append(s[at])
        return pa.table({"row": np.concatenate(rows), "n_best": np.concatenate(best), "count_sum": np.concatenate(sums)})

    parts = salted.groupBy("radix", "group").cogroup(copies.groupBy("radix", "group")).applyInArrow(add, "row long, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
