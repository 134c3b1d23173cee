"""Rank-array BPE against the tokenizers library, and the filter audit against replayed orders."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from partflow.llm import filter_audit, rank_bpe
from partflow.llm.tokens import BYTE_BPE

LIBRARY = Tokenizer.from_file(BYTE_BPE)
BITS = ["a", "B", "7", ".", " ", "  ", "\n", "\n\n", "\t", "'s", "'LL", "é", "<|", "<|endoftext|>", "x.\ny", "-", "\r\n", "你", "１", " ", " ", "\x85", "\x00", "\U000323b0", "՘", "\U0001f600", "the", " and", "zq" * 40, "q" * 90, " " * 70, "ab1" * 30]


def whole(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=20))
def test_ids_and_texts_are_those_of_the_library(texts):
    coded = rank_bpe.coder().encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in coded] == whole(texts)
    assert [rank_bpe.coder().decode(b) for b in coded] == texts


def test_scan_and_heap_agree_and_bounds_cover_the_word(monkeypatch):
    code = rank_bpe.RankBPE(BYTE_BPE)
    words = ["unbelievable", "aaaaaaaaaaaa", "ababababzzzz", "é漢字kana"]
    for word in words:
        raw = word.encode()
        [(rows, parts, bounds)] = code.short_words(np.frombuffer(raw, np.uint8).reshape(1, -1))
        assert parts[0].tolist() == code.long_word(raw).tolist() == whole([word])[0]
        assert b"".join(raw[a:b] for a, b in zip(bounds[0], bounds[0][1:])) == raw
        assert [code.decode_bytes(np.array([i])).tobytes() for i in parts[0]] == [raw[a:b] for a, b in zip(bounds[0], bounds[0][1:])]


def test_store_is_emptied_and_long_texts_come_in_blocks(monkeypatch):
    monkeypatch.setattr(rank_bpe, "KEEP", 40)
    monkeypatch.setattr(rank_bpe, "LONG_TEXT", 64)
    code = rank_bpe.RankBPE(BYTE_BPE)
    texts = [" ".join(f"w{i * k}" for k in range(30)) + "<|endoftext|>" + "y" * 200 for i in range(20)] + [None, "", "short one"]
    assert [np.frombuffer(b, "<u4").tolist() for b in code.encode(texts)] == whole(texts)


def test_special_tokens_as_plain_text():
    plain = Tokenizer.from_file(BYTE_BPE)
    plain.encode_special_tokens = True
    text = "a<|endoftext|> b"
    assert np.frombuffer(rank_bpe.RankBPE(BYTE_BPE, special=False).encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_decoding_of_any_ids():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 40):
        ids = rng.integers(0, LIBRARY.get_vocab_size(), n)
        assert rank_bpe.coder().decode(ids.astype("<u4").tobytes()) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_digest(corpus, rows):
    want = Counter((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), ids in zip(rows, whole([t for _, t in rows])))
    assert Counter(map(tuple, rank_bpe.bpe_digest(corpus).collect())) == want


def test_encoded_tables_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", None), (2, None, "y", 2.0)], "ids long, text string, value string, `c0` double")
    coded = rank_bpe.encode_texts(docs, into="made")
    assert coded.columns == ["ids", "value", "c0", "made"]
    back = rank_bpe.decode_ids(coded, ids="made", into="text").orderBy("ids").collect()
    assert [tuple(r) for r in back] == [(1, "x", None, "a b"), (2, "y", 2.0, "")]


def test_empty_tables(empty, spark):
    assert rank_bpe.bpe_digest(empty).count() == 0
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def replayed(docs, labels):
    """Every order applied filter by filter, to plain lists."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, part in docs:
        text = text or ""
        w = word.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": i is not None and i > first[text]}
        parts.setdefault(part or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in found)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                sums[f] += len(gone)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(sums[f])
    return out


@pytest.fixture(scope="module")
def audited(spark):
    prose = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, prose, "a"), (2, prose, "a"), (2, prose, "b"), (3, "SHORT AND LOUD #", "a"), (4, None, "a"), (5, "", None), (6, "", ""), (None, prose, "b"), (None, None, None),
        (7, "same " * 300, "b"), (8, prose + " $", "a"), (9, "same " * 300, "b"), (10, "Five Hundred", "b"), (0, "x", "b"), (12, "x", "a"), (12, "x", "a"), (13, "é" * 40 + "A", "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 0, 1), (9, 1, 1), (12, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "'x' AS fails", "0 AS part", "'y' AS words").repartition(3)
    return docs, labels, frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS source")


def test_audit_is_what_replayed_orders_give(audited):
    docs, labels, frame, label_frame = audited
    found = filter_audit.audit(frame, label_frame).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found} == replayed(docs, labels)
    assert len(found) == 4 * 600


@pytest.mark.parametrize("n", [2, 3, 5])
def test_weights_are_those_of_all_orders(n):
    want = [[0] * (1 << n) for _ in range(n)]
    for order in permutations(range(n)):
        before = 0
        for i in order:
            want[i][before] -= 1
            want[i][before | 1 << i] += 1
            before |= 1 << i
    found = filter_audit.shapley_weights(n)
    assert [row[1:] for row in found] == [row[1:] for row in want]  # the empty coalition removes nothing
