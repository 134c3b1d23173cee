"""Near duplicates, substrings and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from partflow.llm import near_dedup, quality, substring_dedup
from partflow.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, window=20):
    """Words kept of each row, rows of one doc_id in any order that the operator may take."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        w = WORD.findall(rows[i][1] or "")
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = True
            seen.add(key)
        out[i] = (rows[i][0], len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return Counter(out.values())


def test_substrings_match_brute_force(corpus, rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(corpus).collect())
    assert got == brute_substrings(rows)


def test_substrings_of_shifted_overlaps(spark):
    """A window first seen inside a longer repeat, with repeats that end at different places."""
    w = [f"x{i}" for i in range(80)]
    rows = [(5, " ".join(w)), (7, " ".join(["q", *w[10:45], "r"])), (9, " ".join(["s", *w[20:60]])), (3, " ".join(w[:22])), (11, " ".join(w[:40] + w[:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digest(docs).collect())
    assert got == brute_substrings(rows)


def test_substring_filter_keeps_columns(corpus, rows):
    out = substring_dedup.filter_substrings(corpus)
    assert out.columns == corpus.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    lost = {k[0] for k, _ in brute_substrings(rows).items() if k[2] and k[1] == k[2]}
    assert not (lost - {0}) & kept.keys() and kept[4] == dict(rows)[4]


def distance(a, b):
    """Edit distance over words, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near(a, b):
    big = max(len(a), len(b))
    return min(len(a), len(b)) >= 0.8 * big and (a == b or distance(a, b) <= 0.2 * big + 1e-9)


def brute_classes(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if texts[a] and texts[b] and near(texts[a], texts[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    want = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            want[rows[i][0], min(ids) if ids else None, len(members)] += 1
    return want


def classes(docs):
    return Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicate_classes(docs).collect())


def test_near_duplicates_match_brute_force(corpus, rows):
    """Classes are the components of pairs whose edit similarity over words is 0.8 or more."""
    assert classes(corpus) == brute_classes(rows)


def test_edited_copies_match_brute_force(spark):
    """Clouds of copies with up to a fifth of their words changed, short ones too, behind one common passage."""
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(12)]
    for group in range(14):
        base = [f"g{group}w{rng.randrange(60)}" for _ in range(rng.choice([6, 9, 15, 40, 70]))]
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 5 + 2)):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [f"n{rng.randrange(999)}"] * rng.randrange(2)
            rows.append((len(rows), " ".join(passage[: rng.randrange(13)] + w)))
    want = brute_classes(rows)
    found = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum((want & found).values()) >= 0.95 * len(rows)
    assert all(n <= max(m for i, _, m in want if i == d) for d, _, n in found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_similarity_is_exact(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, len(a) // 3 + 1))):
        p = data.draw(st.integers(0, len(b)))
        b[p : p + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.integers(0, 6), max_size=1))
    if b:
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert near_dedup.similar([x, y], y).tolist() == [near(a, b), True] and near_dedup._aligned_distance(x, y) >= distance(a, b)
        most = [max(len(a), len(b)) // 3, 0]
        got = near_dedup._banded_distances([x, y], y, most)
        assert (got[0] == distance(a, b) if distance(a, b) <= most[0] else got[0] > most[0]) and got[1] == 0


@pytest.mark.parametrize("many, listed", [(16, 30), (2, 30), (1, 1 << 16)])
def test_last_round_joins_all_rare_pairs(spark, monkeypatch, many, listed):
    """The exact join behind the leaders finds every near pair of different roots by itself, whichever words count as held by many."""
    monkeypatch.setattr(near_dedup, "MANY", many)
    rng, rows = random.Random(5), []
    for group in range(9):
        base = [f"g{group}w{rng.randrange(40)}" for _ in range((2, 4, 5, 6, 8, 10, 13, 30, 31)[group])]
        for _ in range(6):
            w = list(base)
            for _ in range(len(w) // 6 + 1):
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[], [f"n{rng.randrange(9)}"], [w[p], "x"]])
            rows.append((len(rows), " ".join(w or base)))
    nodes = near_dedup._nodes(spark.createDataFrame(rows, "doc_id long, text string"))
    left = nodes.select("node", "n", F.col("node").alias("root"))
    pairs = near_dedup._rare_pairs(left, nodes, 0.8, listed=listed)
    found = {frozenset(x) for x in near_dedup._verified(pairs, nodes, 0.8).collect()}
    node = {r.node: r.text.split() for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("node"), "text").collect()}
    assert found == {frozenset((a, b)) for a in node for b in node if a != b and near(node[a], node[b])}


def test_chain_of_near_copies_is_one_class(spark):
    """Neighbours are similar, ends are not: the class must still hold all."""
    w = [f"v{i}" for i in range(300)]
    texts = []
    for step in range(12):
        texts.append(" ".join(w))
        w[step * 25 : step * 25 + 3] = [f"n{step}{j}" for j in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()} == {0}


def test_one_of_each_class_stays(corpus):
    out = near_dedup.filter_near_duplicates(corpus)
    assert out.columns == corpus.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(0) == 1 and ids.count(3) == 1 and 25 not in ids and 26 not in ids and None in ids


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in connected_components(links).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
    assert connected_components(links.where("1 = 0")).count() == 0


def measures(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    strip = " \t\n\x0b\x0c\r"
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_digits": sum(c in "0123456789" for c in text), "n_letter_words": sum(any(c > "\x7f" or c.isalpha() for c in x) for x in w), "n_top_word": max(Counter(w).values(), default=0),
        "n_bullets": sum(x.strip(strip)[0] in "-*•" for x in lines), "n_ellipses": sum(x.strip(strip).endswith(("...", "…")) for x in lines),
    }


def rejecting(m):
    n, lines = m["n_words"], m["n_lines"]
    tests = {
        "few_words": n < 10, "repeats": 100 * m["n_repeat_words"] > 20 * n, "symbols": 10 * m["n_symbols"] > n, "word_length": not 2 * n <= m["word_chars"] <= 15 * n, "line_repeats": 2 * m["n_dup_lines"] > lines, "digits": 2 * m["n_digits"] > m["word_chars"],
        "letter_words": 2 * m["n_letter_words"] < n, "top_word": 10 * m["n_top_word"] > 4 * n, "bullets": lines >= 5 and 10 * m["n_bullets"] > 9 * lines, "ellipses": lines >= 5 and 10 * m["n_ellipses"] > 3 * lines,
    }
    return {name for name, hit in tests.items() if hit}


@pytest.fixture(scope="module")
def judged(spark, rows):
    """The shared corpus and texts that each rule rejects."""
    prose = "these are a few plain words of a clean text that nothing is said against at all"
    more = [prose, "\n".join(f"- {prose} {i}" for i in range(6)), "\n".join(f"{prose} {i} ...\t" for i in range(6)), "• a\n" * 3 + prose, "1234567 " * 3 + "77 88 99 1 2 3 four five", "-- 12 -- 13 !! ?? a b c d", " ".join(["so"] * 6 + [f"v{i}" for i in range(6)]), "…\n…" + prose, "# $ % " + prose, " ".join(["word" * 9] * 3 + [f"{'z' * 40}{i}" for i in range(9)]), f"{prose}\n{prose}\n{prose}\n"]
    texts = [t for _, t in rows] + more
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), texts


def test_quality_measures(judged):
    docs, texts = judged
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want, r = measures(text), got[i]
        assert {m: r[m] for m in quality.BASE} == {m: want[m] for m in quality.BASE}
        base = bool(rejecting(want) & set(quality.BASE_RULES))
        assert (r.base_failed, r.kept) == (base, not rejecting(want)) and (r.rules_run == 0) == base
        assert r.rejected_by is None if base else (r.rejected_by is None) == (not rejecting(want))


def test_order_of_rules_changes_cost_alone(judged):
    docs, texts = judged
    names = [r.name for r in quality.RULES]
    for order in (names, names[::-1], names[3:] + names[:3]):
        for r in quality.cascade(docs, order, result="q").collect():
            hits = rejecting(measures(texts[r.doc_id]))
            assert r.q.rejected_by == next((n for n in order if n in hits), None)
            assert r.q.rules_run == (order.index(r.q.rejected_by) + 1 if hits else len(order))  # later measures are not taken
    with pytest.raises(ValueError):
        quality.cascade(docs, names[1:])


def test_rule_order_is_greedy(judged):
    docs, texts = judged
    order = quality.rule_order(docs)
    assert sorted(n for n, _, _ in order) == sorted(r.name for r in quality.RULES)
    standing = [rejecting(measures(t)) for t in texts]
    for name, cost, share in order:
        assert cost > 0 and share == pytest.approx(sum(name in s for s in standing) / max(1, len(standing)))
        standing = [s for s in standing if name not in s]


def test_filters_pass_columns_of_any_name(corpus):
    names = ["key", "turn", "id", "copy", "row", "found", "order", "_id", "_node", "_copy", "_gone", "_hash", "_quality", "node", "n", "text_"]
    extra = corpus.withColumns({c: F.lit(c) for c in names})
    for apply in (quality.filter_quality, near_dedup.filter_near_duplicates, substring_dedup.filter_substrings):
        out, plain = apply(extra), apply(corpus)
        assert out.columns == extra.columns
        found = out.collect()
        assert all(r[c] == c for r in found for c in names)
        assert Counter((r.doc_id, r.text, r.quality) for r in found) == Counter((r.doc_id, r.text, r.quality) for r in plain.collect())


def test_empty_tables(empty):
    assert substring_dedup.substring_digest(empty).count() == 0
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    assert quality.quality_report(empty).count() == 0
    assert quality.filter_quality(empty).count() == near_dedup.filter_near_duplicates(empty).count() == substring_dedup.filter_substrings(empty).count() == 0
