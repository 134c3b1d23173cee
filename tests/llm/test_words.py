import re
import resource
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from partflow.llm.shared import tidy
from partflow.llm.tokens import BYTE_BPE, Encoder
from partflow.llm.words import join_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b<", max_size=30)), max_size=12), st.integers(1, 9))
def test_hashes_are_of_words(texts, size):
    hashes, rows = word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert [len(WORD.findall(t or "")) for t in texts] == np.diff(rows).tolist() and len(flat) == len(hashes)
    seen = {}
    for i, h in enumerate(join_hashes(hashes, size).tolist()):
        assert seen.setdefault(tuple(flat[i : i + size]), h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab  \n\t'sé .1<|", max_size=14), min_size=1, max_size=20))
def test_memo_gives_the_tokenizers_ids(texts):
    encoder = Encoder.cached = getattr(Encoder, "cached", None) or Encoder(BYTE_BPE)
    texts = [*texts, "", "<|endoftext|>", " x ", None]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, rows = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(rows, rows[1:])] == want
    ids, rows = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(rows, rows[1:])] == want


def test_finished_tasks_give_memory_back():
    """What a task has freed does not stay with its worker, though a block allocated last holds the heap's end."""

    def resident() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() >> 20

    kept, seen = [], []

    def run(batches):
        for batch in batches:
            blocks = [bytes(60_000) for _ in range(4000)]
            kept.append(bytes(60_000))
            del blocks
            yield batch
        seen.append(resident())

    assert list(tidy(run)(iter([1]))) == [1]
    assert kept and resident() < seen[0] - 100
