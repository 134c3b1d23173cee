"""Byte-pair encoding by a contiguous rank array, and decoding.

A text is cut into words by the tokenizer's pattern. A word starts as its bytes: ``bounds`` holds where its
parts begin and end, ``ranks`` the merge rank of each two neighbours, both without gaps. The least rank, the
first one on a tie, names the boundary that goes; the ranks to its left and right are looked up anew, until no
neighbours merge. New words of one length go through this side by side: each step takes one boundary from every
word that still merges, so that their rows stay equally long. Words of more than ``SHORT`` bytes take a heap of
ranks over linked parts in place of the scan, which would be quadratic. Words up to ``SHORT`` are kept with
their ids, at most ``KEEP`` of them in a worker.

Strings of special tokens in a text are that token, as in the ``tokenizers`` library, unless ``special`` is off.
The pattern's letters and numbers follow the installed ``regex``; a text with a character that is newer than the
library's tables is cut by the library.

Defined results: null and empty texts have no ids; ids of several texts stay apart; repeated rows count each;
long texts are cut block by block; an empty table gives an empty result; kept columns may have any names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from partflow.llm.shared import fresh
from partflow.llm.tokens import BYTE_BPE
from partflow.llm.words import ranges

SHORT = 48
KEEP = 400_000
LONG_TEXT = 1 << 20
_SLICE = 2 << 20
_NONE = np.int64(1 << 40)
_ASSIGNED = regex.compile(r"[\p{L}\p{N}\s]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


@cache
def _newer(char: str) -> bool:
    """Whether ``regex`` knows a letter, number or space that older tables leave unassigned."""
    return unicodedata.category(char) == "Cn" and _ASSIGNED.match(char) is not None


class RankBPE:
    """Ids of texts and texts of ids, by the merges of a tokenizer file."""

    def __init__(self, path: str, special: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = np.array([vocab[c] for c in letters], np.int64)  # the id of each byte
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.by_pair = None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()} if special else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.known = dict(self.added)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging two neighbours, _NONE where they do not merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE)

    def short_words(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of one length, as rows of bytes: (rows, their part ids, their part bounds) for each number of parts left."""
        n, size = words.shape
        rows, parts, bounds = np.arange(n), self.first[words], np.tile(np.arange(size + 1), (n, 1))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        found = []
        while len(rows) and ranks.shape[1]:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            done = least == _NONE
            if done.any():
                found.append((rows[done], parts[done], bounds[done]))
                rows, parts, bounds, ranks, at, least = (x[~done] for x in (rows, parts, bounds, ranks, at, least))
            m, width = len(rows), parts.shape[1]
            each = np.arange(m)
            parts[each, at] = self.merged[least]
            parts = parts[np.arange(width) != at[:, None] + 1].reshape(m, width - 1)
            bounds = bounds[np.arange(width + 1) != at[:, None] + 1].reshape(m, width)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(m, width - 2)
            for side, mine in ((at - 1, at > 0), (at, at < width - 2)):  # the neighbours of the merged part
                k, j = each[mine], side[mine]
                ranks[k, j] = self.rank(parts[k, j], parts[k, j + 1])
        if len(rows):
            found.append((rows, parts, bounds))
        return found

    def long_word(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length: the same merges from a heap of (rank, place) over linked parts."""
        if self.by_pair is None:
            self.by_pair = {k: (int(r), int(self.merged[r])) for k, r in zip(self.keys.tolist(), self.order)}
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.by_pair.get
        heap = [(m[0], i, ids[i] << 32 | ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 32 | ids[j] != pair:  # a part of it has been merged since
                continue
            ids[i], ids[j] = get(pair)[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i] << 32 | ids[k]))
            if (k := before[i]) >= 0 and (m := get(ids[k] << 32 | ids[i])):
                heapq.heappush(heap, (m[0], k, ids[k] << 32 | ids[i]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit numbers."""
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            sized.setdefault(min(len(raw), SHORT + 1), []).append((word, raw))
        out = {word: self.long_word(raw).astype("<u4").tobytes() for word, raw in sized.pop(SHORT + 1, ())}
        for size, group in sized.items():
            for rows, parts, _ in self.short_words(np.frombuffer(b"".join(raw for _, raw in group), np.uint8).reshape(-1, size)):
                ids, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
                out.update((group[row][0], ids[k * step : (k + 1) * step]) for k, row in enumerate(rows.tolist()))
        return out

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, in lists; those of a long text come block by block."""
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [piece]  # a special token
            elif not piece.isascii() and any(map(_newer, set(piece))):
                yield [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]
            elif len(piece) <= LONG_TEXT:
                yield self.pattern.findall(piece)
            else:
                found = (m.group() for m in self.pattern.finditer(piece))
                while block := list(islice(found, LONG_TEXT // 8)):
                    yield block

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """The ids of at least these words."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > KEEP:
            self.known = dict(self.added)
            new = words.difference(self.known)
        learnt = self.learn(new)
        long = {w: ids for w, ids in learnt.items() if len(w) > SHORT}
        self.known.update((w, ids) for w, ids in learnt.items() if len(w) <= SHORT)
        return self.known | long if long else self.known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers. The new words of all texts but long ones are learnt together."""
        short = {i: [w for block in self.words(t) for w in block] for i, t in enumerate(texts) if t and len(t) <= LONG_TEXT}
        known = self._known(set().union(*short.values()))
        out = [b""] * len(texts)
        for i, words in short.items():
            out[i] = b"".join(map(known.__getitem__, words))
        for i, text in enumerate(texts):
            if text and i not in short:
                out[i] = b"".join(b"".join(map(self._known(set(block)).__getitem__, block)) for block in self.words(text))
        return out

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        return self.raw[ranges(self.starts[ids], self.sizes[ids])]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.frombuffer(ids, "<u4").astype(np.int64)).tobytes().decode("utf-8", errors="replace")


@cache
def coder(path: str = BYTE_BPE, special: bool = True) -> RankBPE:
    """The encoder of this worker."""
    return RankBPE(path, special)


def _mapped(df: DataFrame, column: str, into: str, kind: str, make) -> DataFrame:
    """``df`` with ``into`` in place of ``column``: what ``make`` gives for the values of a slice."""
    kept = [c for c in df.columns if c != column]
    names = [f"c{i}" for i in range(len(kept))]
    value = fresh("value", names)
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)), F.col(f"`{column}`").alias(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False)) // _SLICE
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1) if batch.num_rows else ():
                part = batch.slice(rows[0], len(rows))
                made = pa.array(make(part.column(part.num_columns - 1).to_pylist()), pa.string() if kind == "string" else pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*names, "made"])

    fields = ", ".join([*(f"{n} {source.schema[n].dataType.simpleString()}" for n in names), f"made {kind}"])
    return source.mapInArrow(run, fields).toDF(*kept, into)


def encode_texts(docs: DataFrame, text: str = "text", into: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """``docs`` with the ids of its texts (binary, little-endian unsigned 32-bit numbers) in place of the texts."""
    return _mapped(docs, text, into, "binary", lambda texts: coder(tokenizer).encode(texts))


def decode_ids(encoded: DataFrame, ids: str = "ids", into: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """``encoded`` with the texts of its ids in place of the ids; null ids give an empty text."""
    return _mapped(encoded, ids, into, "string", lambda rows: [coder(tokenizer).decode(x or b"") for x in rows])


def bpe_digest(docs: DataFrame, text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids of whole texts and the texts decoded from those ids."""
    coded = encode_texts(docs.select("doc_id", F.col(text).alias("text")), tokenizer=tokenizer)
    coded = coded.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode_ids(coded, tokenizer=tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
