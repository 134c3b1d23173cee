"""Token counts, packed files and best-fit packing against whole encodings."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partflow.llm import best_fit, packed_output, token_counts, tokens
from partflow.llm.shared import shared_dir
from partflow.llm.tokens import BYTE_BPE, encoder


@pytest.fixture(scope="session")
def encoded(rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "7", ".", ",", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "<|", "<|endoftext|>", "x.\ny", "it's.", "-", "\r\n", "你", "１", "\u00a0", "\u2028", "“"]), max_size=12).map("".join), max_size=30))
def test_ids_are_those_of_whole_texts(texts):
    code = encoder()
    ids, rows = code.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:])] == [x.ids for x in code.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_store_is_emptied_and_filled_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP", 50)
    code = tokens.Encoder(BYTE_BPE)
    for lo in range(0, 400, 40):
        texts = [" ".join(f"w{i * k}" for k in range(9)) for i in range(lo, lo + 40)]
        ids, rows = code.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:])] == [x.ids for x in code.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_length_table(corpus, encoded):
    table = token_counts.length_table(corpus)
    sizes = [len(ids) for _, ids in encoded]
    for r in table.collect():
        k = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_over, r.tokens_over) == (sizes.count(k), sum(n >= k for n in sizes), sum(n for n in sizes if n >= k), sum(n > k for n in sizes), sum(n for n in sizes if n > k))
        assert r.tokens_cut == sum(min(n, k) for n in sizes) and r.share == pytest.approx(sum(n <= k for n in sizes) / len(sizes))
    assert {r.limit: r.tokens_cut for r in token_counts.cut_totals(table, [0, 17, 512, 10**6]).collect()} == {x: sum(min(n, x) for n in sizes) for x in (0, 17, 512, 10**6)}
    assert token_counts.quantiles(table, [0.5]).first().n_tokens == sorted(sizes)[math.ceil(len(sizes) / 2) - 1]


def test_length_table_by_group(corpus):
    table = token_counts.length_table(corpus, ("source",))
    assert table.groupBy().sum("n_docs").first()[0] == corpus.count()
    assert {r.source for r in table.collect()} == {"src0", "src1", "src2", None}


def check_pieces(found, encoded, capacity):
    want = Counter()
    for i, ids in encoded:
        ids = [*ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want


@pytest.mark.parametrize("capacity", [64, 2048])
def test_best_fit_is_whole_and_tight(corpus, encoded, capacity):
    found = best_fit.pack(corpus, capacity=capacity).collect()
    check_pieces(found, encoded, capacity)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids) + 1 for _, ids in encoded)
    decreasing = len(packed_output.best_fit_decreasing([r.length for r in found], capacity))
    assert math.ceil(total / capacity) <= len(sequences) <= decreasing + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    packed = packed_output.best_fit_decreasing(lengths, 40)
    assert sorted(i for p in packed for i in p) == list(range(len(lengths)))
    room = []
    for n in sorted(lengths, reverse=True):  # the same by plain search
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(40 - n)
    assert sorted(40 - sum(lengths[i] for i in p) for p in packed) == sorted(room)


def test_hot_size_is_ranked_in_salted_classes(spark):
    """One length that most pieces have, in classes of at most 20 rows: the packing is as tight as in one class."""
    docs = spark.createDataFrame([(i, "a b c" if i % 3 else f"a{'b ' * (i % 11)}") for i in range(300)], "doc_id long, text string").repartition(3)
    made = [best_fit.pack(docs, capacity=16, class_rows=n).collect() for n in (20, 1 << 16)]
    for found in made:
        assert len(found) == 300
        places = {}
        for r in found:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in p) <= 16 and sorted(o for o, _ in p) == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in places.values())
    assert abs(len({r.sequence_id for r in made[0]}) - len({r.sequence_id for r in made[1]})) <= 1


def test_length_table_groups_of_any_name(corpus):
    names = ("group", "block", "all", "tokens")
    table = token_counts.length_table(corpus.withColumns({c: F.lit(c) for c in names}), names)
    assert all(r[c] == c for r in table.collect() for c in names) and table.groupBy().sum("n_docs").first()[0] == corpus.count()


def test_files_round_trip(spark, corpus, encoded):
    index = packed_output.write_packed(corpus, shared_dir(spark, "packed-test"), capacity=64)
    found = packed_output.read_packed(index, capacity=64).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32").collect()
    check_pieces(found, encoded, 64)
    for r in index.collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1] and len(r.pieces) == len(r.resets)


def test_empty_tables(empty):
    assert token_counts.length_table(empty).count() == 0
    assert best_fit.pack(empty).count() == 0
    assert packed_output.packed_report(empty).count() == 0
