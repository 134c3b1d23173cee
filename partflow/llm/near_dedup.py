"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Two texts are near duplicates if their edit similarity is ``threshold`` or more: 1 - d / max(|A|, |B|), d
being the edit distance over words. Their sketches are taken of five-word shingles labelled with their
occurrence number, so each is unique in its text. A sketch keeps the ``L`` smallest shingles under one
hash and hashes them *in text order*. Of ``SKETCHES`` sketches, texts that agree on one meet in its bucket.
Texts of under 100 words also get sketches of two three-word grams, those of under 40 of one two-word
gram, since a single changed word moves most of their shingles.

Candidates. Equal texts are one node. In a bucket each text is compared with a leader, which then leaves
the bucket; a bucket goes on while it holds two texts of different classes, for ``ROUNDS`` leaders. The
texts that are left in such buckets are joined exactly, by a prefix filter: texts of the threshold have
0.8 * n words in common, so one among the 0.2 * n + 1 rarest words of each. Words of common passages and
lines are the least rare, so they join hardly anything. Links are closed by large-star/small-star rounds. No
bucket is collected and nothing is capped.

Verification. A pair is settled by the lengths, by the number of common words (a lower bound of the
distance), by an alignment along the words that are unique in both (an upper bound), and only then by
dynamic programming in a band of width 2d + 1. A leader's words are sent once for each ``GROUP`` of its
candidates, not once a pair.

A pair whose shingles have Jaccard similarity J meets with probability 1 - (1 - J ** 4) ** 64: 0.98 at 0.5,
0.81 at 0.4; members of a class are found through any of its links. Fewer shingles a sketch would find
more of the rest, but a passage that many texts share would then put most of them in common buckets. Recall
over pairs, by itself and through classes: README.

Defined results: null texts and texts without a word are classes of their own, one a document; a text
of under five words has one shingle, its whole word sequence; repeated rows and rows with a null doc_id
take the class of their text; columns of any name pass through the filter; an empty table gives an empty
result. Words are compared by 32-bit hashes inside a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from partflow.llm.components import connected_components
from partflow.llm.shared import drop_stored, fresh, release, stored, stored_by, tidy
from partflow.llm.words import join_hashes, mix, row_index, run_rank, slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES = 64
L = 4
#: Words a gram, grams a sketch, sketches, and under how many words a text has them.
KINDS = ((SHINGLE, L, SKETCHES, 1 << 62), (3, 2, 16, 100), (2, 1, 16, 40))
ROUNDS = 3
LISTED = 1 << 16
GROUP = 256
MANY = 16
CELLS = 1 << 15
SLICE = 3 << 20
BATCH_ROWS = 2000

_U = np.uint64
_LABEL = _U(0xA24BAED4963EE407)
_SEEDS = np.random.default_rng(613).integers(1, 2**63, SKETCHES, dtype=np.uint64) * _U(2) + _U(1)


def labelled_grams(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the runs of ``size`` words in text order, and for each row the index of its first.

    ``h`` holds word hashes, ``rows`` where each text begins (one entry more). A shorter text is one gram.
    """
    n = np.diff(rows)
    grams = join_hashes(h, size)
    row = row_index(rows)
    inside = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < size))
    whole = np.zeros(len(few), np.uint64)
    for i in range(size - 1):
        more = few[n[few] > i]
        whole[n[few] > i] = mix(whole[n[few] > i] * _U(31) + h[rows[more] + i])
    at = np.concatenate([row[inside], few])
    order = np.argsort(at, kind="stable")
    tokens, at = np.concatenate([grams[inside], whole])[order], at[order]
    return mix(tokens + run_rank(tokens, at).astype(np.uint64) * _LABEL), np.searchsorted(at, np.arange(len(rows)))


def sketches(tokens: np.ndarray, rows: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """One row a text, one column a seed: its ``size`` smallest tokens (all, if fewer), hashed in text order. No text is empty."""
    n, out = np.diff(rows), np.zeros((len(rows) - 1, len(seeds)), np.uint64)
    if not len(n):
        return out
    row = row_index(rows)
    for k, seed in enumerate(seeds):
        rank, places = tokens * seed, []
        for _ in range(size):
            place = np.flatnonzero(rank == np.minimum.reduceat(rank, rows[:-1])[row])
            if len(place) != len(n):  # a text has run out of tokens: all of it has the largest rank now
                place = place[np.searchsorted(row[place], np.arange(len(n)))]
            places.append(place)
            rank[place] = ~_U(0)
        key = np.full(len(n), mix(seeds[k : k + 1] + _U(size))[0], np.uint64)
        for place in np.sort(np.stack(places), axis=0):
            key = mix(key * _U(0x9FB21C651E98DF25) + tokens[place])
        out[:, k] = key
    return out


def _aligned_distance(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the edit distance: along the words unique in both, position by position where the gap is as long on both sides."""
    own_a, at_a, count_a = np.unique(a, return_index=True, return_counts=True)
    own_b, at_b, count_b = np.unique(b, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(own_a[count_a == 1], own_b[count_b == 1], assume_unique=True, return_indices=True)
    i, j = at_a[count_a == 1][x], at_b[count_b == 1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) < 0).any():  # longest increasing run of places
        tails, last, before = [], [], np.full(len(j), -1)
        for k, v in enumerate(j.tolist()):
            p = bisect_left(tails, v)
            tails[p : p + 1], last[p : p + 1] = [v], [k]
            before[k] = last[p - 1] if p else -1
        chain = [last[-1]]
        while before[chain[-1]] >= 0:
            chain.append(before[chain[-1]])
        i, j = i[chain[::-1]], j[chain[::-1]]
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    gap_a, gap_b = np.diff(i) - 1, np.diff(j) - 1
    even = gap_a == gap_b
    starts, sizes = i[:-1][even] + 1, gap_a[even]
    ends = np.cumsum(sizes)
    each = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    shift = np.repeat((j - i)[:-1][even], sizes)
    return int(np.maximum(gap_a, gap_b)[~even].sum() + (a[each] != b[each + shift]).sum())


def _banded_distances(texts: list[np.ndarray], b: np.ndarray, most: list[int]) -> np.ndarray:
    """The edit distance of each text to ``b``, or more than its ``most`` if it is larger: all at once, in one band of diagonals."""
    wide = max(most)
    width, far = 2 * wide + 1, 2 * wide + 2
    kind = np.int16 if far < 1 << 14 else np.int32
    lane, limit = np.arange(width, dtype=kind), np.array(most)
    sizes = np.array([len(a) for a in texts])
    words = np.zeros((len(texts), sizes.max()), np.int64)
    for k, a in enumerate(texts):
        words[k, : len(a)] = a.astype(np.int64) + 1
    padded = np.concatenate([np.full(wide + 1, -1), b.astype(np.int64) + 1, np.full(width + words.shape[1], -1)])
    row = np.tile(np.where(lane >= wide, lane - wide, far).astype(kind), (len(texts), 1))  # row 0: column = lane - wide
    end = len(b) - sizes + wide
    out = np.full(len(texts), far, np.int64)
    out[sizes == 0] = len(b)
    for i in range(1, words.shape[1] + 1):
        diagonal = row + (padded[i : i + width] != words[:, i - 1, None])
        row[:, :-1] = row[:, 1:]
        row[:, -1] = far
        row += 1
        np.minimum(row, diagonal, out=row)
        if i <= wide:
            row[:, wide - i] = i
            row[:, : wide - i] = far
        row -= lane
        np.minimum.accumulate(row, axis=1, out=row)
        row += lane
        np.minimum(row, far, out=row)
        done = np.flatnonzero((sizes == i) & (end >= 0) & (end < width))
        out[done] = row[done, end[done]]
        if i % 16 == 0 and (row.min(axis=1) > limit)[sizes > i].all():
            break
    return out


def _most(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    return int((1 - threshold) * max(len(a), len(b)) + 1e-9)


def _settled(a: np.ndarray, b: np.ndarray, threshold: float) -> bool | None:
    """Whether the edit similarity is ``threshold`` or more, where bounds of the distance tell; else null."""
    most = _most(a, b, threshold)
    if abs(len(a) - len(b)) > most:
        return False
    k = min(len(a), len(b))
    apart = np.flatnonzero(a[:k] != b[:k])
    if len(apart) <= most and len(a) == len(b):
        return True
    head = int(apart[0]) if len(apart) else k
    apart = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = min(int(apart[0]) if len(apart) else k, k - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    big = max(len(a), len(b))
    if big <= most:
        return True
    own_a, count_a = np.unique(a, return_counts=True)
    own_b, count_b = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(own_a, own_b, assume_unique=True, return_indices=True)
    if big - np.minimum(count_a[x], count_b[y]).sum() > most:
        return False
    return True if _aligned_distance(a, b) <= most else None


def similar(texts: list[np.ndarray], b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether the edit similarity of each word sequence to ``b`` is ``threshold`` or more."""
    found = [_settled(a, b, threshold) for a in texts]
    open_ = sorted((i for i, x in enumerate(found) if x is None), key=lambda i: len(texts[i]))
    while open_:  # as many at once as keep the band in a cache
        most = [_most(texts[i], b, threshold) for i in open_]
        many = max(1, int(np.searchsorted(np.arange(1, len(open_) + 1) * (2 * np.array(most) + 1), CELLS)))
        part, most = open_[:many], most[:many]
        for i, far, limit in zip(part, _banded_distances([texts[i] for i in part], b, most), most):
            found[i] = far <= limit
        open_ = open_[many:]
    return np.array(found, bool)


def _word_slices(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of whole rows of about SLICE bytes of words, one row at least."""
    at = np.cumsum(pc.binary_length(batch.column(words)).fill_null(0).to_numpy(zero_copy_only=False)) // SLICE
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(at)) + 1) if batch.num_rows else ():
        yield batch.slice(rows[0], len(rows))


def _nodes(docs: DataFrame) -> DataFrame:
    """(node, n, keys, words) of each distinct text with a word: the hash of the text, its number of words, sketches, 32-bit word hashes.

    Copies meet by their words alone; sketches are taken of what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE) if batch.num_rows else ():
                h, rows = word_hashes(part.column(1))
                live = np.flatnonzero(np.diff(rows))
                if not len(live):
                    continue
                at = np.append(rows[live], rows[-1]) * 4
                words = pa.Array.from_buffers(pa.binary(), len(live), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer((h >> _U(32)).astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(live)), words], ["node", "words"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _word_slices(batch, "words"):
                texts = _words(part.column("words"))
                n = np.array([len(w) for w in texts], np.int64)
                h = mix(np.concatenate(texts).astype(np.uint64) + _U(1))
                of, keys = [], []
                for gram, size, count, below in KINDS:
                    mine = np.flatnonzero(n < below)
                    starts = np.concatenate([[0], np.cumsum(n[mine])])
                    keys.append(sketches(*labelled_grams(h[np.repeat(n < below, n)], starts, gram), _SEEDS[:count], size).ravel())
                    of.append(np.repeat(mine, count))
                of = np.concatenate(of)
                flat = np.concatenate(keys)[np.argsort(of, kind="stable")]
                at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n.astype(np.int32)), lists, part.column("words")], ["node", "n", "keys", "words"])

    rows = docs.select(F.xxhash64("text").alias("node"), "text").mapInArrow(tidy(run), "node long, words binary")
    return rows.groupBy("node").agg(F.first("words").alias("words")).mapInArrow(tidy(sketched), "node long, n int, keys array<bigint>, words binary")


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, np.uint32) for x in column]


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold.

    Rows are sorted by b; its own words come once before those of each group of its candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            b = batch.column(1).to_numpy()
            words, is_leader = _words(batch.column(2)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], is_leader[1:] | (b[1:] != b[:-1])])) if len(b) else []
            keep = np.zeros(len(b), bool)
            for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
                if is_leader[lo]:
                    leader = words[lo].copy()
                    lo += 1
                if lo < hi:
                    keep[lo:hi] = similar(words[lo:hi], leader, threshold)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    words = nodes.select("node", "words")
    mine = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("group"))
    mine = mine.join(words.withColumnRenamed("node", "a"), "a").select("a", "b", "group", "words")
    lead = groups.join(words.withColumnRenamed("node", "b"), "b").select(F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "words")
    dealt = mine.unionByName(lead).repartition("b", "group").sortWithinPartitions("b", "group", F.col("a").asc_nulls_first())
    return dealt.select("a", "b", "words").mapInArrow(tidy(run), "a long, b long")


def _labelled_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = _words(column)
    rows = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    return labelled_grams(mix(np.concatenate([np.zeros(0, np.uint32), *words]).astype(np.uint64) + _U(1)), rows, 1)


_SIGNS = [f"s{i}" for i in range(8)]


def _signatures(tokens: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Parity bits of each text's labelled words, 64 a column of ``_SIGNS``: two texts differ in no more bits than words that one of them lacks."""
    bits = tokens >> _U(64 - 9)
    odd = np.zeros((n, 64 * len(_SIGNS)), np.uint8)
    np.bitwise_xor.at(odd, (row, bits), np.uint8(1))
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def _rare_pairs(left: DataFrame, nodes: DataFrame, threshold: float, listed: int = LISTED, made: list[DataFrame] | None = None) -> DataFrame:
    """The pairs of nodes (node, n, root) of different roots that share one of their rarest words.

    Words are labelled with their occurrence number. Texts of the threshold have threshold * n of them in
    common, so one among the n - threshold * n + 1 that come first in any order. The order is by how many
    texts hold a word, as far as the ``listed`` most frequent of the words that two roots hold go (a table
    of fixed size), others before them. Where all of those are listed, other words join nothing, and a
    text with fewer than threshold * n listed words has no partner. Of texts that share such a word only those are
    paired whose lengths and word signatures leave room for threshold * n words in common, and of the words that
    ``MANY`` texts hold only the first that two have in common pairs them.
    """
    made = made if made is not None else []  # tables that the caller may drop
    texts = stored(left.join(nodes.select("node", "words"), "node").select("node", "n", "root", "words"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _word_slices(whole, "words")):
            tokens, ends = _labelled_words(batch.column(0))
            roots = batch.column(1).to_numpy()[row_index(ends)]
            order = np.lexsort((roots, tokens))
            own, at, n = np.unique(tokens[order], return_index=True, return_counts=True)
            low, high = roots[order][at], roots[order][at + n - 1]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n), pa.array(low), pa.array(high)], ["word", "texts", "low", "high"])

    counts = texts.select("words", "root").mapInArrow(tidy(count), "word long, texts long, low long, high long")
    counts = counts.groupBy("word").agg(F.sum("texts").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("word", "texts")
    known = np.array(counts.orderBy(F.desc("texts"), "word").limit(listed).collect(), np.int64).reshape(-1, 2)  # at most ``listed`` rows
    known = known[np.argsort(known[:, 0].view(np.uint64))]
    shared = left.sparkSession.sparkContext.broadcast((known[:, 0].view(np.uint64).copy(), known[:, 1].copy()))
    whole = len(known) < listed  # every word that two roots hold is listed: others join nothing

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held = shared.value
        for batch in (part for whole in batches for part in _word_slices(whole, "words")):
            tokens, ends = _labelled_words(batch.column(3))
            n, row = np.diff(ends), row_index(ends)
            at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
            texts_with = np.where(common[at] == tokens, held[at], 0) if len(common) else np.zeros(len(tokens), np.int64)
            order = np.lexsort((tokens, texts_with, row))
            need = np.ceil(threshold * n - 1e-9).astype(np.int64)
            take = np.arange(len(tokens)) - ends[row] < (n - need + 1)[row]
            if whole:
                able = np.bincount(row[texts_with > 0], minlength=len(n)) >= need
                take &= (texts_with[order] > 0) & able[row]
            take = order[take]
            back = pa.array(row[take])
            signs = [pa.array(x.view(np.int64)).take(back) for x in _signatures(tokens, row, len(n)).T.copy()]
            held_by_many = texts_with[take] >= MANY
            ends_hot = np.concatenate([[0], np.cumsum(np.bincount(row[take][held_by_many], minlength=len(n)))]).astype(np.int32)
            hot = pa.ListArray.from_arrays(pa.array(ends_hot), pa.array(tokens[take][held_by_many].view(np.int64))).take(pa.array(row[take], mask=~held_by_many))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[take].view(np.int64)), *(batch.column(c).take(back) for c in range(3)), hot, *signs], ["word", "node", "n", "root", "hot", *_SIGNS])

    rare = stored(texts.mapInArrow(tidy(first), "word long, node long, n int, root long, hot array<bigint>, " + ", ".join(f"{c} long" for c in _SIGNS)), "rare", BATCH_ROWS)
    made += [texts, rare]
    x = rare.select("word", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("hot").alias("ha"), *(F.col(c).alias(f"a{c}") for c in _SIGNS))
    y = rare.select("word", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("hot").alias("hb"), *(F.col(c).alias(f"b{c}") for c in _SIGNS))
    big = F.greatest("na", "nb")
    near = F.least("na", "nb") >= threshold * big - 1e-9
    apart = reduce(add, (F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _SIGNS))
    alike = apart <= F.col("na") + F.col("nb") - 2 * F.ceil(threshold * big - 1e-9)
    once = F.col("ha").isNull() | (F.get(F.array_intersect("ha", "hb"), F.lit(0)) == F.col("word"))
    return x.join(y, "word").where((F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & near & alike & once).select("a", "b").distinct()


def _links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(member, root) of every node that has a near duplicate; the root is the smallest node of the class."""
    buckets = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").cast("int").alias("size")).where("size > 1")
    members = stored(buckets.join(shared, "bucket").select("bucket", "size", "node", "n"), "buckets")
    roots, tried, made = None, None, [members]  # all of them are dropped but the roots
    for turn in range(ROUNDS + 1):
        if roots is None:
            named = members.withColumn("root", F.col("node"))
        else:
            named = members.join(roots, members["node"] == roots["member"], "left").select("bucket", "size", "node", "n", F.coalesce("root", "node").alias("root"))
        lead = named.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(turn))).alias("l"), F.min("root").alias("r1"), F.max("root").alias("r2"))
        rest = named.join(lead.where("r1 != r2").select("bucket", "l"), "bucket")
        if turn < ROUNDS:
            rest = stored(rest.where("node != l.node"), "buckets")
            made.append(rest)
            near = F.least("n", "l.n") >= threshold * F.greatest("n", "l.n") - 1e-9
            pairs = rest.where((F.col("root") != F.col("l.root")) & near).select(F.col("node").alias("a"), F.col("l.node").alias("b"))
            members = rest.where(F.col("size") > turn + 2).select("bucket", "size", "node", "n")  # two at least are left
        else:
            left = stored(rest.select("node", "n", "root").distinct(), "left")
            made.append(left)
            pairs = _rare_pairs(left, nodes, threshold, made=made)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti")
        pairs = stored(pairs, "pairs")
        again = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tried = again if tried is None else tried.union(again)
        found = stored(_verified(pairs, nodes, threshold), "links", BATCH_ROWS)
        made += [pairs, found]
        if roots is None:
            roots = stored(connected_components(found).select(F.col("node").alias("member"), "root"), "roots")
        elif not found.isEmpty():
            made.append(roots)
            roots = stored(_joined_roots(roots, found), "roots")
    drop_stored(*made)
    return roots


def _joined_roots(roots: DataFrame, found: DataFrame) -> DataFrame:
    """(member, root) after more links (a, b): only the links between roots are closed, members follow theirs."""
    links = found
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("member").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    tops = stored(connected_components(links).select("node", F.col("root").alias("top")), "tops")
    moved = roots.join(tops, roots["root"] == tops["node"], "left").select("member", F.coalesce("top", "root").alias("root"))
    lone = tops.select(F.col("node").alias("member"), F.col("top").alias("root")).join(roots.select("member"), "member", "left_anti")
    return moved.union(lone)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, node, class_id, class_size and whether the text is the one of its class that stays."""
    nodes = stored_by(_nodes(docs), "nodes", "node")
    roots = _links(nodes, threshold)
    drop_stored(nodes)
    release(docs.sparkSession)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    known = docs.select("doc_id", F.xxhash64("text").alias("node"), worded.alias("worded"))
    named = known.where("worded").join(roots, F.col("node") == F.col("member"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("node").alias("node")))
    classes = named.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    grouped = named.join(classes, "root").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), "class_size", stays.alias("stays"))
    alone = known.where("NOT worded").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("stays"))
    return grouped.union(alone)


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id of its class) and class_size (documents)."""
    return _classes(docs.select("doc_id", "text"), threshold).select("doc_id", "class_id", "class_size")


def filter_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class left, that of the smallest doc_id; texts without a word all stay."""
    key, turn = (fresh(c, docs.columns) for c in ("key", "turn"))
    # A struct is never null, so one shuffle of the texts serves the join and the window.
    gone = _classes(docs.select("doc_id", "text"), threshold).where("NOT stays").select(F.struct("doc_id", "node").alias(key)).distinct()
    left = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("node"))).join(gone, key, "left_anti")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = left.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    return left.where((F.col(turn) == 1) | ~worded).select(*docs.columns)
