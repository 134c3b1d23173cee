"""Cross-tokenizer alignment against plain loops, and spill counting against dictionaries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from partflow.llm import alignment, rank_bpe, spill_count
from partflow.llm.tokens import BYTE_BPE

A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
LETTER = {c: b for b, c in enumerate(rank_bpe.byte_letters())}
A_BYTES = {i: bytes(LETTER[c] for c in t) for t, i in A.get_vocab().items() if t != "<|endoftext|>"}


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(A ids, B ids, groups as text, links) of one text."""
    if not text:
        return [], [], "", []
    whole = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if b"".join(A_BYTES[i] for i in a) != whole or b"".join(map(b_bytes, b)) != whole:
        return [], [], "", []
    spans = []
    for ids, size in ((a, lambda i: len(A_BYTES[i])), (b, lambda i: len(b_bytes(i)))):
        at, found = 0, []
        for i in ids:
            found.append((at, at + size(i), i))
            at += size(i)
        spans.append(found)
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e] if len(whole) < 3000 else None
    stops = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = []
    for lo, hi in zip([0, *stops], stops):
        groups.append("|".join(",".join(str(i) for s, e, i in side if lo < e <= hi) for side in spans) if len(whole) < 3000 else "")
    return a, b, ";".join(groups), links


BITS = ["a", "B", "7", ".", " ", "  ", "\n", "\t", "'s", "é", "<|endoftext|>", "<s>", "<0x0A>", "▁", "你", "\x00", " the", "and ", "\U0001f600", "ﬁ", " ", "--", "word"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=12))
def test_alignment_of_texts(texts):
    found = alignment.align(pa.array([" " + t if t else "" for t in texts], pa.string()))
    for k, text in enumerate(texts):
        a, b, groups, links = plain(text)
        assert (found.n_a[k], found.n_b[k], found.n_groups[k], found.n_links[k]) == (len(a), len(b), groups.count(";") + bool(groups), len(links))
        assert found.groups[found.at[k] : found.at[k + 1]].tobytes().decode().removesuffix(";") == groups
        mine = found.row == k
        assert list(zip(found.a[mine].tolist(), found.b[mine].tolist())) == links


@pytest.mark.parametrize("buffer, fan_in", [(spill_count.BUFFER, spill_count.FAN_IN), (100, 3)])
def test_counts_of_the_whole_table(spark, monkeypatch, buffer, fan_in):
    """Also with a run for each few documents, which takes several levels of merges."""
    monkeypatch.setattr(spill_count, "FAN_IN", fan_in)
    texts = ["the cat sat on the mat", "the cat sat", "the dog's café ran", None, "", "has ▁ mark", "the cat sat", "x<|endoftext|>y", " two  spaces ", "日本語 the"] + [f"item {i} of the list, number {i * 7}" for i in range(60)]
    docs = spark.createDataFrame([(None if i == 2 else i, t, 1, "g") for i, t in enumerate(texts)], "doc_id long, text string, row int, groups string").repartition(3)
    found = Counter(tuple(r) for r in alignment.align_tokenizers(docs, buffer=buffer).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    count = Counter(pair for t in texts for pair in set(plain(t)[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = Counter()
    for i, t in enumerate(texts):
        a, b, groups, links = plain(t)
        want[None if i == 2 else i, len(a), len(b), groups.count(";") + bool(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""] += 1
    assert found == want


def test_groups_and_empty_table(spark, corpus, rows, empty):
    short = corpus.where(F.length("text") < 2000)
    assert Counter((r.doc_id, r.groups) for r in alignment.alignment_groups(short).collect()) == Counter((i, plain(t)[2]) for i, t in rows if t is not None and len(t) < 2000)
    assert alignment.align_tokenizers(empty).count() == 0


def test_runs_merge_to_counts_and_maxima(monkeypatch):
    monkeypatch.setattr(spill_count, "BLOCK", 16)
    rng = np.random.default_rng(3)
    runs, want, bits = defaultdict(list), Counter(), None
    for base in range(0, 90, 10):
        writer = spill_count.RunWriter(1000, 70, base)
        bits = writer.bits_b
        for _ in range(5):
            a, b, doc = (np.minimum(rng.zipf(1.3, 400), 900), rng.integers(0, 70, 400), rng.integers(0, 2, 400))
            for pair in {(int(writer.keys(x, y)[()]), int(d)) for x, y, d in zip(a, b, doc)}:
                want[pair[0]] += 1
            writer.add(a, b, doc, 2)
        for radix, at, heads, _ in writer.spill():
            assert at == base
            runs[radix].append(heads)
    found, best = {}, Counter()
    for key, n in want.items():
        best[key >> bits] = max(best[key >> bits], n)
    for radix in runs:
        last = -1
        for keys, counts, highest in spill_count.with_maxima(spill_count.merged(runs[radix]), bits):
            for key, n, top in zip(keys.tolist(), counts.tolist(), highest.tolist()):
                assert key > last and top == (n == best[key >> bits])
                found[key], last = n, key
    assert found == want
