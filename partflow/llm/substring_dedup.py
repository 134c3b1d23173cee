"""Removal of word sequences that occur earlier in the corpus, by seed and extend.

1. Anchors. In every run of ``W`` consecutive ``K``-word grams the rightmost smallest hash is kept
   (winnowing), with K + W - 1 = the window length, so two equal windows hold the same anchor at the
   same place. Documents are joined on anchors: an anchor found twice or more is a seed.
2. Extension. A seed reaches left and right over all windows that it anchors. Its whole reach is
   compared first: a reach that starts earlier elsewhere needs nothing more. What remains is compared
   window by window, so the result is exact, not only as long as the longest common reach.
3. Repeated windows that touch are put together into maximal spans; covered words are removed.

Skew: before each shuffle a task settles what repeats inside its own batch and sends on one row a key,
so a passage held by a third of all documents is at most one row a batch. No group is collected.

Defined results: null and empty texts have no words and lose none; a document shorter than the window
loses none; rows that share a doc_id are taken in the order of their texts' hashes, each as a document
of its own; a null doc_id comes before all others; an empty table gives an empty result. Keys are 64-bit
hashes of 20 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from partflow.llm.shared import fresh, tidy
from partflow.llm.words import join_hashes, mix, row_index, slices, text_bytes, span_hashes, word_bounds, word_hashes

WINDOW = 20
K = 5
SLICE = 4 << 20


def _anchors(h: np.ndarray, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes; starts of the windows that lie in one row; the anchor of each of those."""
    grams = join_hashes(h, k)
    w = window - k + 1
    if len(h) < window:
        return grams, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step, left = np.arange(len(grams)), 1, w
    best, covered = None, 0
    while left:  # rightmost smallest over w grams, from runs of 1, 2, 4, ...
        if left & 1:
            if best is None:
                best = at
            else:
                a, b = best[: len(at) - covered], at[covered:][: len(best)]
                a = a[: len(b)]
                best = np.where(grams[b] <= grams[a], b, a)
            covered += step
        left >>= 1
        if left:
            a, b = at[:-step], at[step:]
            at = np.where(grams[b] <= grams[a], b, a)
            step *= 2
    row = row_index(rows)
    n = len(h) - window + 1
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    return grams, inside, best[inside]


def _split_known(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key has come earlier in this batch, and of those that come first; input is in document order."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    return np.flatnonzero(again), np.flatnonzero(~again)


def find_anchors(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(gram, doc_id, pos, known): known anchors repeat inside a batch; their gram is a random number and one row speaks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE) if batch.num_rows else ():
                h, rows = word_hashes(part.column(1))
                grams, _, chosen = _anchors(h, rows, window, k)
                chosen = np.unique(chosen)
                row = row_index(rows)[chosen] if len(chosen) else chosen
                key = grams[chosen]
                ids = part.column(0).take(pa.array(row))
                pos = pa.array((chosen - rows[row]).astype(np.int32) if len(chosen) else chosen.astype(np.int32))
                again, first = _split_known(key)
                repeated = np.isin(key, key[again]) if len(again) else np.zeros(len(key), bool)
                send = [(first, key[first], False)]
                if len(again):
                    known = np.flatnonzero(repeated)
                    send.append((known, mix(key[known] + (chosen[known] + 1).astype(np.uint64)), True))
                for at, gram, flag in send:
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), ids.take(at), pos.take(at), pa.array(np.full(len(at), flag))], ["gram", "doc_id", "pos", "known"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(tidy(run), f"gram long, doc_id {source.schema['doc_id'].dataType.simpleString()}, pos int, known boolean")


def _in_order(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by doc_id and copy, null ids first."""
    return part.take(pc.sort_indices(part, sort_keys=[("doc_id", "ascending"), ("copy", "ascending")], null_placement="at_start"))


def _runs(at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of consecutive positions of a row."""
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])) if len(at) else np.zeros(0, np.int64)
    return cut, np.diff(np.append(cut, len(at)))


def _seed_reaches(texts: DataFrame, id_type: str, window: int, k: int) -> DataFrame:
    """(key, doc_id, copy, start, n, known): the windows that each seed anchors; known ones repeat inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE) if batch.num_rows else ():
                part = _in_order(part)
                h, rows = word_hashes(part.column(2))
                grams, inside, chosen = _anchors(h, rows, window, k)
                if not len(inside):
                    continue
                seeds = part.column(3)
                at = np.repeat(rows[:-1], np.asarray(seeds.value_lengths().fill_null(0))) + seeds.flatten().to_numpy(zero_copy_only=False)
                mark = np.zeros(len(h) + 1, bool)
                mark[at[at < len(h)]] = True
                take = mark[chosen]
                starts, anchor = inside[take], chosen[take]
                if not len(starts):
                    continue
                windows = join_hashes(h, window)
                cut, size = _runs(starts, anchor)
                first = starts[cut]
                reach = mix(windows[first] * np.uint64(31) + windows[first + size - 1] + size.astype(np.uint64))
                row = row_index(rows)[first]
                again, _ = _split_known(reach)
                known = np.zeros(len(first), bool)
                known[again] = True
                key = np.where(known, mix(reach + (first + 1).astype(np.uint64)), reach)
                back = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(back), part.column(1).take(back), pa.array((first - rows[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(known)], ["key", "doc_id", "copy", "start", "n", "known"])

    return texts.mapInArrow(tidy(run), f"key long, doc_id {id_type}, copy int, start int, n int, known boolean")


def _single_windows(texts: DataFrame, id_type: str, window: int) -> DataFrame:
    """(key, doc_id, copy, start, n): runs that are settled (n > 0), and the windows of the others one by one (n = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE) if batch.num_rows else ():
                part = _in_order(part)
                h, rows = word_hashes(part.column(2))
                windows = join_hashes(h, window)
                marks = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.asarray(marks.value_lengths()))
                copy, start, n, again = (marks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
                own = copy == part.column(1).to_numpy()[owner]
                owner, at, n, again = owner[own], (rows[owner] + start)[own], n[own].astype(np.int64), again[own].astype(bool)
                single, width = at[~again], n[~again]
                ends = np.cumsum(width)
                each = np.sort(np.repeat(single - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0))
                repeated, fresh = _split_known(windows[each])
                row = row_index(rows)
                cut, size = _runs(each[repeated], row[each[repeated]])
                at = np.concatenate([at[again], each[repeated][cut], each[fresh]])
                n = np.concatenate([n[again], size, np.zeros(len(fresh), np.int64)])
                if not len(at):
                    continue
                settled = np.arange(len(at)) < len(at) - len(fresh)
                key = np.where(settled, mix(windows[at] + (at + 1).astype(np.uint64)), windows[at])
                back = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(back), part.column(1).take(back), pa.array((at - rows[row[at]]).astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "doc_id", "copy", "start", "n"])

    return texts.mapInArrow(tidy(run), f"key long, doc_id {id_type}, copy int, start int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(texts by id and ``copy`` number, runs of repeated windows (doc_id, copy, start, n))."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # A struct of the id is never null, so that null ids join; texts are shuffled by it once for all joins.
    texts = docs.select(F.struct("doc_id").alias("id"), "text").withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"))))
    order = ["doc_id", "copy", "start"]

    near = Window.partitionBy("gram").orderBy("doc_id", "pos")
    seeds = (
        find_anchors(docs, window, k).withColumn("before", F.lag("pos").over(near)).withColumn("after", F.lead("pos").over(near))
        .where(F.col("known") | F.col("before").isNotNull() | F.col("after").isNotNull())
        .groupBy(F.struct("doc_id").alias("id")).agg(F.collect_set("pos").alias("seeds"))
    )
    reaches = _seed_reaches(texts.join(seeds, "id").select("id.doc_id", "copy", "text", "seeds"), id_type, window, k)
    turn = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    marks = reaches.withColumn("again", F.col("known") | (turn > 1)).groupBy(F.struct("doc_id").alias("id")).agg(F.collect_list(F.struct("copy", "start", "n", "again")).alias("marks"))
    parts = _single_windows(texts.join(marks, "id").select("id.doc_id", "copy", "text", "marks"), id_type, window)
    turn = F.row_number().over(Window.partitionBy("key", F.col("n") > 0).orderBy(*order))
    runs = parts.withColumn("turn", turn).where((F.col("n") > 0) | (F.col("turn") > 1)).select(*order, F.greatest("n", F.lit(1)).alias("n"))
    return texts, runs


def _covered(n_words: int, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + sizes + window - 1, n_words), -1)
    return np.cumsum(edge)[:n_words] > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, the maximal removed spans (start and end word), kept_text and kept_sha256.

    kept_text is the text as it was where nothing is removed, else the kept words joined by one space;
    kept_sha256 is of the joined words always.
    """
    docs = docs.select("doc_id", "text")
    texts, runs = repeated_windows(docs, window, k)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = runs.groupBy(F.struct("doc_id").alias("id")).agg(F.collect_list(F.struct("copy", "start", "n")).alias("runs"))
    mine = F.filter("runs", lambda r: r["copy"] == F.col("copy"))
    joined = texts.join(spans, "id", "left").withColumn("runs", mine).select("id.doc_id", "copy", "text", F.col("runs.start").alias("s"), F.col("runs.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                raw, offsets = text_bytes(part.column(2))
                starts, ends, rows = word_bounds(raw, offsets)
                data, out = raw.tobytes(), {"n_words": [], "n_removed": [], "spans": [], "kept_text": [], "kept_sha256": []}
                for i, (s, n) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                    a, b = rows[i], rows[i + 1]
                    total = int(b - a)
                    gone = _covered(total, np.array(s or [], np.int64), np.array(n or [], np.int64), window)
                    keep = np.flatnonzero(~gone) + a
                    kept = b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
                    for name, value in (("n_words", total), ("n_removed", int(gone.sum())), ("spans", [{"start": int(x), "end": int(y)} for x, y in edge]), ("kept_text", kept.decode() if gone.any() else data[offsets[i] : offsets[i + 1]].decode()), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                        out[name].append(value)
                kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept_text": pa.string(), "kept_sha256": pa.string()}
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(out[c], kinds[c]) for c in kinds)], ["doc_id", "copy", *kinds])

    return joined.mapInArrow(tidy(run), f"doc_id {id_type}, copy int, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string, kept_sha256 string")


def filter_substrings(docs: DataFrame) -> DataFrame:
    """The documents with their kept words as text (n_chars follows); documents of which nothing is left go.

    A document that loses nothing keeps its text as it was, white space included (null becomes empty).
    """
    row, found, id_, copy, order = (fresh(c, docs.columns) for c in ("row", "found", "id", "copy", "order"))
    result = dedup_substrings(docs).select(F.struct("doc_id").alias(id_), F.col("copy").alias(copy), F.struct("n_removed", "n_words", "kept_text").alias(found))
    rest = docs.select(F.struct("doc_id").alias(id_), F.xxhash64("text").alias(order), F.struct(*(c for c in docs.columns if c != "text")).alias(row))
    rest = rest.withColumn(copy, F.row_number().over(Window.partitionBy(id_).orderBy(order)))
    gone, text = F.col(found)["n_removed"], F.col(found)["kept_text"]
    joined = rest.join(result, [id_, copy]).where((gone == 0) | (gone < F.col(found)["n_words"]))
    new = {c: F.col(row)[c] for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in new:
        new["n_chars"] = F.when(gone > 0, F.char_length(text)).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new[c].alias(c) for c in docs.columns))


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``documents``."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
