"""Packed token-id matrices in binary files.

Each task packs its own documents by best-fit decreasing: pieces by falling length, each into the
sequence with the smallest room that holds it, found in a segment tree over the room that is left
(0 ... capacity), so a search costs log(capacity) steps. Documents longer than the capacity are split
without loss. A file is a matrix of ``capacity`` ids a row (16 bits where the vocabulary allows), padded
with ``pad``; the index table has, for each row, the cumulative segment lengths, the positions at which
position ids start again at 0, and the pieces. Rows are packed in groups of about ``GROUP`` tokens, which
bounds a task's memory. Only files of finished tasks are in the index, so lost tasks leave nothing that
is read.

Defined results: every document is closed by ``end``; null and empty texts are that one id; repeated
rows are packed one by one; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from partflow.llm.shared import shared_dir, stored
from partflow.llm.tokens import BYTE_BPE, encoder
from partflow.llm.words import slices

CAPACITY = 2048
GROUP = 6_000_000


class RoomTree:
    """Which amounts of room some sequence has; finds the smallest amount that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _shift(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._shift(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``size``, removed from the tree."""
        node = self.leaves + size
        if not self.counts[node]:
            while node and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if not node:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._shift(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces (as positions in ``lengths``) of each sequence."""
    tree, sequences = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i]) if sequences else None
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        room, at = found
        sequences[at].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], at)
    return sequences


INDEX = "path string, row long, id_bytes int, n_tokens int, cu_seqlens array<int>, resets array<int>, pieces array<struct<doc_id:{id},piece:int,start:long,length:int>>"


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, tokenizer: str = BYTE_BPE, end: int = 0, pad: int = 0) -> DataFrame:
    """Write matrices below ``path``; returns the index, one row a sequence."""
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        code = encoder(tokenizer)
        width = "<u2" if max(code.size, end + 1, pad + 1) <= 1 << 16 else "<u4"
        name, written, out = f"{uuid.uuid4().hex}.bin", 0, None
        parts, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, written, parts, size
            pieces = []
            for doc_id, ids in parts:
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                pieces += [(doc_id, k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            packed = best_fit_decreasing([len(p[3]) for p in pieces], capacity)
            matrix = np.full((len(packed), capacity), pad, width)
            columns = {c: [] for c in ("path", "row", "id_bytes", "n_tokens", "cu_seqlens", "resets", "pieces")}
            for r, members in enumerate(packed):
                cu = [0]
                for i in members:
                    matrix[r, cu[-1] : cu[-1] + len(pieces[i][3])] = pieces[i][3]
                    cu.append(cu[-1] + len(pieces[i][3]))
                for c, value in (("path", f"{path}/{name}"), ("row", written + r), ("id_bytes", matrix.itemsize), ("n_tokens", cu[-1]), ("cu_seqlens", cu), ("resets", cu[:-1])):
                    columns[c].append(value)
                columns["pieces"].append([{"doc_id": pieces[i][0], "piece": pieces[i][1], "start": pieces[i][2], "length": len(pieces[i][3])} for i in members])
            if out is None:
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
            out.write(matrix.tobytes())
            written += len(packed)
            parts, size = [], 0
            kinds = {"path": pa.string(), "row": pa.int64(), "id_bytes": pa.int32(), "n_tokens": pa.int32(), "cu_seqlens": pa.list_(pa.int32()), "resets": pa.list_(pa.int32())}
            piece = pa.list_(pa.struct([("doc_id", arrow_id), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], (kinds | {"pieces": piece})[c]) for c in columns], list(columns))

        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else ():
                ids, ends = code.encode_closed(part.column(1), end)
                ids = ids.astype(width)
                parts += [(doc_id, ids[a:b]) for doc_id, a, b in zip(part.column(0).to_pylist(), ends, ends[1:])]
                size += len(ids)
                if size >= GROUP:
                    yield flush()
        if parts:
            yield flush()
        if out is not None:
            out.close()

    return stored(source.mapInArrow(run, INDEX.format(id=id_type)), "packed-index")


def read_packed(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids as read from the matrices: doc_id, piece, start, length, offset, ids (32-bit little-endian)."""
    id_type = index.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, open_path, handle = [], None, None
            arrow_id = batch.schema.field("pieces").type.value_type.field("doc_id").type
            for x in batch.to_pylist():
                if x["path"] != open_path:
                    if handle is not None:
                        handle.close()
                    store, name = fs.FileSystem.from_uri(x["path"])
                    open_path, handle = x["path"], store.open_input_file(name)
                row = capacity * x["id_bytes"]
                handle.seek(x["row"] * row)
                ids = np.frombuffer(handle.read(row), f"<u{x['id_bytes']}")
                for a, b, p in zip(x["cu_seqlens"], x["cu_seqlens"][1:], x["pieces"]):
                    rows.append((p["doc_id"], p["piece"], p["start"], b - a, a, ids[a:b].astype("<u4").tobytes()))
            if handle is not None:
                handle.close()
            if rows:
                kinds = (arrow_id, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "offset", "ids"])

    columns = index.select("path", "row", "id_bytes", "cu_seqlens", "pieces")
    return columns.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, offset long, ids binary")


def packed_report(docs: DataFrame) -> DataFrame:
    """Write all documents, read the matrices back, and give each piece with the checksum of the ids read."""
    index = write_packed(docs, shared_dir(docs.sparkSession, "packed"))
    return read_packed(index).select("doc_id", "piece", "start", "length", "offset", F.crc32("ids").alias("ids_crc32"))
