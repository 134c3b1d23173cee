"""Token streams of two tokenizers over the same text, aligned by byte offsets.

Both encode a space and the text: tokenizer A byte-level, tokenizer B sentence pieces, which adds that space itself.
Offsets where tokens of both end cut them into groups. Tokens whose byte ranges overlap are linked; between two
neighbouring ends of either side lies exactly one link. A pair's count is the number of documents of the whole table
that hold it linked; ``spill_count`` counts pairs and hands back what each document needs.

A's ids come from the cached segments of ``tokens``, with special tokens as plain text. B's pieces never go on behind a
space, so a text in which each space stands between two other characters is cut before every space and B's ids are
kept by segment likewise; other texts are encoded whole.

Defined results: a text that is null or empty, or whose tokens of A or B do not spell the space and the text (such as one
with U+2581), has no tokens and counts nowhere: zeros, and '' for the groups; repeated rows are documents of their own; a
null doc_id is kept; a very long text is held whole in its task; an empty table gives an empty result; kept columns may
have any names that the result does not use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from partflow.llm.rank_bpe import RankBPE
from partflow.llm.shared import fresh, stored
from partflow.llm.spill_count import BUFFER, RUN_FIELDS, RunWriter, contributions, count_runs
from partflow.llm.tokens import BYTE_BPE, Encoder
from partflow.llm.words import ranges, slices, text_bytes

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
_SLICE = 2 << 20
_ROWS = 1 << 40  # documents of one task, at most


class PlainEncoder(Encoder):
    """Byte-level ids; the strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


class PieceEncoder(Encoder):
    """Ids of texts that start with the space which the model adds by itself."""

    def __init__(self, path: str) -> None:
        self.model = SentencePieceProcessor(model_file=path)
        self.size, self.leads = self.model.get_piece_size(), {}
        self._forget()

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def _segmented(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank, goes_on = raw == 0x20, np.zeros(len(raw), bool)
        goes_on[:-1] = ~blank[1:]
        goes_on[offsets[1:][offsets[1:] > 0] - 1] = False
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(blank & ~goes_on), side="right") - 1] = True
        cuts = blank.copy()
        cuts[offsets[:-1][offsets[:-1] < len(raw)]] = False
        sums = np.concatenate([[0], np.cumsum(cuts)])
        starts = np.sort(np.concatenate([np.flatnonzero(cuts), offsets[:-1]]), kind="stable")
        return starts, np.concatenate([[0], np.cumsum(sums[offsets[1:]] - sums[offsets[:-1]] + 1)]), whole


class Spelling(NamedTuple):
    """The bytes of each id of a vocabulary, and the id in decimal digits."""

    raw: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    digits: np.ndarray
    n_digits: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelling:
        sizes = np.array([len(t) for t in tokens], np.int64)
        names = [str(i).encode() for i in range(len(tokens))]
        width = len(names[-1])
        digits = np.frombuffer(b"".join(n.ljust(width + 1) for n in names), np.uint8).reshape(-1, width + 1)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes, digits, np.array([len(n) for n in names]))


@cache
def _side_a(path: str) -> tuple[PlainEncoder, Spelling]:
    table = RankBPE(path, special=False)
    return PlainEncoder(path), Spelling.of([table.raw[a : a + n].tobytes() for a, n in zip(table.starts, table.sizes)])


@cache
def _side_b(path: str) -> tuple[PieceEncoder, Spelling]:
    code = PieceEncoder(path)
    pieces = [code.model.id_to_piece(i) for i in range(code.size)]
    return code, Spelling.of([bytes([int(p[3:5], 16)]) if code.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


class Aligned(NamedTuple):
    """Rows of a slice: counts, the links' ids and rows, and the groups spelled out with where each row's begin."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    a: np.ndarray
    b: np.ndarray
    row: np.ndarray
    groups: np.ndarray
    at: np.ndarray


def _spells(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rows: np.ndarray, spell: Spelling) -> np.ndarray:
    """Whether the tokens of each row spell the row."""
    size, count = np.diff(offsets), np.diff(rows)
    sums = np.concatenate([[0], np.cumsum(spell.sizes[ids])])
    same = (sums[rows[1:]] - sums[rows[:-1]]) == size
    keep = np.flatnonzero(same)
    mine = ids[ranges(rows[keep], count[keep])] if len(keep) < len(same) else ids
    text = raw[ranges(offsets[keep], size[keep])] if len(keep) < len(same) else raw
    differ = np.flatnonzero(spell.raw[ranges(spell.starts[mine], spell.sizes[mine])] != text)
    same[keep[np.searchsorted(np.cumsum(size[keep]), differ, side="right")]] = False
    return same


def align(texts: pa.Array, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> Aligned:
    """The alignment of texts that stand with their space in front; empty ones have no tokens."""
    (code_a, spell_a), (code_b, spell_b) = _side_a(path_a), _side_b(path_b)
    raw, offsets = text_bytes(texts)
    n = len(offsets) - 1
    ids_a, rows_a = code_a.encode(texts)
    ids_b, rows_b = code_b.encode(texts)
    size = np.diff(offsets)
    good = np.flatnonzero((size > 0) & _spells(raw, offsets, ids_a, rows_a, spell_a) & _spells(raw, offsets, ids_b, rows_b, spell_b))
    n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_a[good], n_b[good] = np.diff(rows_a)[good], np.diff(rows_b)[good]
    ids_a, ids_b = ids_a[ranges(rows_a[good], n_a[good])], ids_b[ranges(rows_b[good], n_b[good])]
    stops = np.cumsum(size[good])
    ends_a, ends_b = np.zeros(int(size[good].sum()) + 1, bool), np.zeros(int(size[good].sum()) + 1, bool)
    ends_a[np.cumsum(spell_a.sizes[ids_a])] = ends_b[np.cumsum(spell_b.sizes[ids_b])] = True
    ends = np.flatnonzero(ends_a | ends_b)
    is_a, is_b = ends_a[ends], ends_b[ends]
    both = is_a & is_b
    group = np.cumsum(both) - both
    row = good[np.searchsorted(stops, ends)]
    n_links, n_groups = np.bincount(row, minlength=n), np.bincount(row[both], minlength=n)

    # the tokens as text: those of A in a group, then those of B, each with the sign behind it
    group_a, group_b, total = group[is_a], group[is_b], int(both.sum())
    per_a, per_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
    width = max(spell_a.digits.shape[1], spell_b.digits.shape[1])
    out, used = np.zeros((len(ids_a) + len(ids_b), width), np.uint8), np.zeros(len(ids_a) + len(ids_b), np.int64)
    for ids, place, spell, closes, sign in (
        (ids_a, np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a], spell_a, both[is_a], b"|"),
        (ids_b, np.arange(len(ids_b)) + np.cumsum(per_a)[group_b], spell_b, both[is_b], b";"),
    ):
        out[place, : spell.digits.shape[1]] = spell.digits[ids]
        out[place, spell.n_digits[ids]] = np.where(closes, sign[0], ord(","))
        used[place] = spell.n_digits[ids] + 1
    sums = np.concatenate([[0], np.cumsum(used)])
    return Aligned(
        n_a, n_b, n_groups, n_links, ids_a[np.cumsum(is_a) - is_a], ids_b[np.cumsum(is_b) - is_b], row,
        out[np.arange(width) < used[:, None]], sums[np.concatenate([[0], np.cumsum(n_a + n_b)])],
    )


def _spaced(docs: DataFrame, text: str) -> F.Column:
    return F.when(F.col(text) == "", "").otherwise(F.coalesce(F.concat(F.lit(" "), F.col(text)), F.lit("")))


def alignment_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """The ``keep`` columns and ``groups`` of every row: ``a1,a2|b1;a3|b2,b3``, ids of A and B by group; '' without tokens."""
    return _scan(docs, keep, text, path_a, path_b, 0).select(*keep, "groups")


def _scan(docs: DataFrame, keep: tuple[str, ...], text: str, path_a: str, path_b: str, buffer: int) -> DataFrame:
    """One row per document; with a ``buffer`` also the runs of links that fill it, whose ``radix`` is not null."""
    name = fresh("text", keep)
    source = docs.select(*(F.col(f"`{c}`") for c in keep), _spaced(docs, f"`{text}`").alias(name))
    own = ["row", "n_a", "n_b", "n_groups", "n_links", "groups", *(f.split()[0] for f in RUN_FIELDS.split(", "))]
    types = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) * _ROWS
        at, kinds = base, None
        runs = RunWriter(_side_a(path_a)[0].size, _side_b(path_b)[0].size, base, buffer) if buffer else None

        def spilled() -> Iterator[pa.RecordBatch]:
            for values in runs.spill() if runs.docs else ():
                cells = [pa.array([v], t) for v, t in zip(values, types[6:])]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in [*kinds, *types[:6]]), *cells], names=[*keep, *own])

        for batch in batches:
            kinds = [f.type for f in batch.schema][:-1]
            for part in slices(batch, name, _SLICE) if batch.num_rows else ():
                found, n = align(part.column(part.num_columns - 1), path_a, path_b), part.num_rows
                if runs:
                    runs.add(found.a, found.b, found.row, n)
                groups, ends = found.groups.tobytes(), found.at[1:] - (found.n_a > 0)
                spelled = [groups[a:b] for a, b in zip(found.at.tolist(), ends.tolist())]
                if runs:
                    spelled = [hashlib.sha256(g).hexdigest() if g else "" for g in spelled]
                cells = [pa.array(np.arange(at, at + n)), *(pa.array(x, pa.int64()) for x in found[:4]), pa.array(spelled, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cells, *(pa.nulls(n, t) for t in types[6:])], names=[*keep, *own])
                at += n
                if runs and runs.full:
                    yield from spilled()
        if runs and kinds is not None:
            yield from spilled()

    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}row long, n_a long, n_b long, n_groups long, n_links long, groups string, {RUN_FIELDS}")


def align_tokenizers(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, buffer: int = BUFFER) -> DataFrame:
    """The ``keep`` columns of every row, its numbers of tokens, groups and links, the digest of its groups, and from the counts
    of the whole table n_best (links whose pair is the most frequent of its A token) and count_sum (over all links)."""
    table = stored(_scan(docs, keep, text, path_a, path_b, buffer), "alignment")
    runs = table.where("radix IS NOT NULL").select("radix", "base", "heads", "body")
    n_runs = runs.select("base").distinct().count()
    totals = count_runs(runs, n_runs, RunWriter(_side_a(path_a)[0].size, _side_b(path_b)[0].size, 0).bits_b)
    shares = contributions(runs, totals, n_runs)
    rows = table.where("radix IS NULL").drop("radix", "base", "heads", "body").join(shares, "row", "left")
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.select(*(F.col(f"`{c}`") for c in keep), "n_a", "n_b", "n_groups", "n_links", *filled, F.col("groups").alias("groups_sha256"))
