"""Token ids of whole texts, encoded once for each distinct segment of a worker.

In a byte-level BPE whose pre-tokenizer cuts before each single space between two non-space characters,
such a cut never changes the ids. The same holds of a single line break between two other characters,
and of a stop behind a letter or digit where white space or the end follows. A text is cut there into
segments, each with its leading space or line break. Segments are told apart by a 64-bit hash and their
ids kept in one array, for at most ``KEEP`` of them; new ones are encoded by the ``tokenizers`` library,
many in one text. Nothing loops over words in Python. Texts in which a space stands beside other white
space, or that may hold a special token, are encoded whole.

Two segments of one worker share a hash with a probability of 5e-9 at ``KEEP`` segments.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from partflow.llm.words import mix, ranges, span_hashes, text_bytes

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
KEEP = 400_000
SLICE = 4 << 20
_BLOCK = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_WORD = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: First bytes of white space outside ASCII: a text that may hold such is encoded whole.
_WIDE_PAIRS = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
_U = np.uint64


class Encoder:
    """Ids of texts, by segments that are encoded once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.leads = {}
        for byte, letter in ((0x20, "Ġ"), (0x0A, "Ċ")):
            self.leads[byte] = np.zeros(self.size, bool)
            self.leads[byte][[i for token, i in vocab.items() if token.startswith(letter)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new segments, given by sorted keys and where each stands in ``raw``."""
        found: list[np.ndarray] = []
        sizes = np.zeros(len(keys), np.int64)
        place = np.zeros(len(keys), np.int64)
        at, data = len(self.ids), raw.tobytes()
        lead, last = raw[np.minimum(starts, len(raw) - 1)], raw[np.maximum(ends, 1) - 1]
        batched = np.zeros(len(keys), bool)
        for byte, opens in self.leads.items():
            second = raw[np.minimum(starts + 1, len(raw) - 1)]
            mine = np.flatnonzero((lead == byte) & (ends - starts > 1) & ~_SPACE[last] & ~_SPACE[second])
            block = np.cumsum(ends[mine] - starts[mine]) // _BLOCK
            for group in np.split(mine, np.flatnonzero(np.diff(block)) + 1):
                if not len(group):
                    continue
                text = raw[ranges(starts[group], ends[group] - starts[group])].tobytes().decode()
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(opens[ids])
                if len(cuts) == len(group) and cuts[0] == 0:
                    batched[group] = True
                    place[group], sizes[group] = at + cuts, np.diff(np.append(cuts, len(ids)))
                    found.append(ids)
                    at += len(ids)
        rest = np.flatnonzero(~batched)
        for i, ids in zip(rest, self._alone([data[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])):
            place[i], sizes[i] = at, len(ids)
            found.append(ids)
            at += len(ids)
        self.ids = np.concatenate([self.ids, *found])
        into = np.searchsorted(self.keys, keys)
        self.starts, self.sizes = np.insert(self.starts, into, place), np.insert(self.sizes, into, sizes)
        self.keys = np.insert(self.keys, into, keys)

    def _segmented(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each segment, the first segment of each row (one entry more), and which rows must be encoded whole."""
        n = len(raw)
        space, blank = _SPACE[raw], raw == 0x20
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inner = ~edge[1:n]  # whether a byte and the next one are of one row
        odd = ((blank[:-1] & space[1:]) | (space[:-1] & blank[1:]) | ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))) & inner
        marks = [np.flatnonzero(odd)]
        wide = np.flatnonzero(_WIDE[raw[:-1]])
        for a, b in _WIDE_PAIRS if len(wide) else ():
            marks.append(wide[(raw[wide] == a) & (raw[wide + 1] == b)])
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, np.concatenate(marks), side="right") - 1] = True

        before, after = np.zeros(n, bool), np.zeros(n, bool)  # a byte of the row that is no white space stands beside
        before[1:], after[:-1] = ~space[:-1] & inner, ~space[1:] & inner
        line = (raw == 0x0A) & before & after
        ends = blank | line | edge[:n]
        follows = np.append(ends[1:], True)
        stop = np.zeros(n, bool)
        stop[1:] = _STOP[raw[1:]] & _WORD[raw[:-1]] & inner & follows[1:]
        cuts = blank | line | stop
        cuts[offsets[:-1][offsets[:-1] < n]] = False
        per_row = np.concatenate([[0], np.cumsum(cuts)])
        per_row = per_row[offsets[1:]] - per_row[offsets[:-1]] + 1
        starts = np.sort(np.concatenate([np.flatnonzero(cuts), offsets[:-1]]), kind="stable")
        return starts, np.concatenate([[0], np.cumsum(per_row)]), whole

    def _slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(column)
        if len(raw) < 2:
            texts = [t or "" for t in column.to_pylist()]
            parts = self._alone(texts)
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        starts, first, whole = self._segmented(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        keys = span_hashes(raw, starts, ends)
        heads = np.zeros(len(starts), bool)
        heads[first[:-1]] = True
        keys[heads] = mix(keys[heads] + _U(0x9FB21C651E98DF25))
        live = np.ones(len(starts), bool)
        gone = np.flatnonzero(whole)
        live[ranges(first[gone], first[gone + 1] - first[gone])] = False
        at = np.flatnonzero(live)
        own, where, back = np.unique(keys[at], return_index=True, return_inverse=True)
        new = self._missing(own)
        if len(self.keys) + new.sum() > KEEP:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(raw, own[new], starts[at[where[new]]], ends[at[where[new]]])
        known = np.searchsorted(self.keys, own)
        sizes = np.zeros(len(starts), np.int64)
        sizes[at] = self.sizes[known][back]
        place = np.zeros(len(starts), np.int64)
        place[at] = self.starts[known][back]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        per_row = sums[first[1:]] - sums[first[:-1]]
        ids = self.ids[ranges(place, sizes)]
        if not len(gone):
            return ids, np.concatenate([[0], np.cumsum(per_row)])
        texts = self._alone([t or "" for t in column.take(pa.array(gone)).to_pylist()])
        per_row[gone] = [len(t) for t in texts]
        rows = np.concatenate([[0], np.cumsum(per_row)])
        out = np.zeros(rows[-1], np.uint32)
        mine = np.flatnonzero(~whole)
        out[ranges(rows[mine], per_row[mine])] = ids
        out[ranges(rows[gone], per_row[gone])] = np.concatenate(texts)
        return out, rows

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (unsigned 32-bit), and for each row where its first stands (one entry more); null counts as empty."""
        _, offsets = text_bytes(column)
        parts, rows, lo = [], [np.zeros(1, np.int64)], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
            ids, at = self._slice(column.slice(lo, hi - lo))
            rows.append(at[1:] + rows[-1][-1])
            parts.append(ids)
            lo = hi
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(rows)

    def encode_closed(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the id ``end`` behind every text."""
        ids, rows = self.encode(column)
        n = len(rows) - 1
        out, closed = np.full(len(ids) + n, end, np.uint32), rows + np.arange(n + 1)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(rows))] = ids
        return out, closed


@cache
def encoder(path: str = BYTE_BPE) -> Encoder:
    """The encoder of this worker."""
    return Encoder(path)
