"""Toxicity, mixing, neighbours and WARC files."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partflow.llm import ann, mixing, toxicity, warc
from partflow.llm.shared import shared_dir


def test_pairs_beyond_sums():
    """Two terms that tell nothing alone but all together: an additive model cannot pass both bounds."""
    rng = np.random.default_rng(1)
    terms, labels = [], []
    for _ in range(3000):
        t = set(rng.integers(100, 5000, 40).tolist())
        a, b = rng.random(2) < 0.4
        t |= {1} if a else set()
        t |= {2} if b else set()
        terms.append(np.array(sorted(t)))
        labels.append(float(a and b))
    model = toxicity.fit(terms[:2000], np.array(labels[:2000]))
    row = np.repeat(np.arange(1000), [len(t) for t in terms[2000:]])
    score, truth = model.score(row, np.concatenate(terms[2000:]), 1000), np.array(labels[2000:])
    assert (score[truth == 1] >= 0.7).mean() > 0.95 and (score[truth == 0] >= 0.7).mean() < 0.02


def xor_auc(rng, noise):
    """Held-out area under the curve for labels that are exactly one of two terms."""
    terms, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        t = {int(x) for x in rng.integers(100, 500, noise)} | ({1} if a else set()) | ({2} if b else set())
        terms.append(np.array(sorted(t), np.int32))
        labels.append(float(a != b))
    labels = np.array(labels)
    model = toxicity.fit(terms[:3000], labels[:3000])
    row = np.repeat(np.arange(1000), [len(t) for t in terms[3000:]])
    score, truth = model.score(row, np.concatenate(terms[3000:]), 1000), labels[3000:]
    return (score[truth == 1][:, None] > score[truth == 0]).mean() + 0.5 * (score[truth == 1][:, None] == score[truth == 0]).mean()


@pytest.mark.parametrize("noise", [0, 20])
def test_pair_whose_parts_tell_nothing(noise):
    assert xor_auc(np.random.default_rng(4), noise) > 0.95


def test_margin_is_that_of_all_pairs():
    """The linear-time form against the sum over all pairs."""
    rng = np.random.default_rng(6)
    weights, factors = np.zeros(toxicity.BUCKETS), np.zeros((toxicity.BUCKETS, toxicity.FACTORS))
    weights[:50], factors[:50] = rng.normal(size=50), rng.normal(size=(50, toxicity.FACTORS))
    model = toxicity.FactorizationMachine(0.3, weights, factors)
    sets = [np.sort(rng.choice(60, rng.integers(0, 12), replace=False)) for _ in range(30)]
    got = model.margin(np.repeat(np.arange(30), [len(s) for s in sets]), np.concatenate(sets), 30)
    want = [0.3 + weights[s].sum() + sum(factors[a] @ factors[b] for i, a in enumerate(s) for b in s[:i]) for s in sets]
    assert got == pytest.approx(np.array(want))


def test_scores_keep_columns_of_any_name(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    long = docs.limit(3).withColumns({"text_": F.lit("x"), "_text": F.lit("y"), "text": F.concat("text", F.repeat(F.lit(" more"), 200_000))})
    out = toxicity.score_toxicity(long, model, keep=("doc_id", "text_", "_text", "text"))
    assert out.columns == ["doc_id", "text_", "_text", "text", "score"] and all(r.text_ == "x" and 0 <= r.score <= 1 for r in out.collect())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        w = [f"w{rng.randrange(500)}" for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = "Fool!"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs += [(None, None), (2000, ""), (0, docs[0][1])]
    labels += [(5000, 1, 1), (1, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    out = toxicity.toxicity_report(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.score < 0.01 for r in toxicity.toxicity_report(docs, labels.where("1 = 0")).collect())
    assert toxicity.toxicity_report(docs.where("1 = 0"), labels).count() == 0


def test_mixing_meets_targets(labelled):
    docs, labels = labelled
    rows = mixing.mixing_rates(docs, labels, weights=[0.5, 0.0, 0.5]).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    totals = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS])
    assert totals[0] == pytest.approx(totals[2], rel=0.05)
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)


def test_rates_are_projected_least_squares(spark):
    """The fit against plain projected gradient over one rate a document, by the error it reaches."""
    rng = np.random.default_rng(2)
    for scale, weights in ((1.0, [0.7, 0.2, 0.1]), (0.3, [0.98, 0.01, 0.01])):
        n, p = rng.integers(1, 50, 40), rng.dirichlet([0.3, 0.3, 0.3], 40)
        members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
        steps, wanted, have = mixing.fit_rates(members, weights, total=float(n.sum()) * scale)
        rates = np.array([r[0] for r in members.select(mixing.rate(steps)).collect()])
        part = p * n[:, None]
        assert rates.min() >= 0 and part.T @ rates == pytest.approx(np.array(have))
        plain, step = np.ones(40), 1 / np.linalg.norm(part, 2) ** 2
        for _ in range(20_000):
            plain = np.maximum(0, plain - step * part @ (part.T @ plain - wanted))
        error = lambda r: np.linalg.norm(part.T @ r - wanted) / np.linalg.norm(wanted)
        assert error(rates) <= error(plain) + 1e-3


def test_mixing_of_odd_rows(spark, labelled):
    """Null posteriors add nothing; rows that share an id draw by their texts."""
    members = spark.createDataFrame([(3, [0.5, 0.5, 0.0]), (None, [1.0, 0.0, 0.0]), (2, None)], "n_tokens long, p array<double>")
    steps, wanted, have = mixing.fit_rates(members, [0.5, 0.5, 0.0])
    assert have == pytest.approx(wanted)
    docs, labels = labelled
    same = docs.withColumn("doc_id", F.lit(7).cast("long"))
    assert mixing.mixing_rates(same, labels, weights=[0.2, 0.4, 0.4], total=5000.0).select("copies").distinct().count() > 1


def test_tokens_are_the_pieces_of_the_pre_tokenizer(spark):
    from tokenizers.pre_tokenizers import ByteLevel

    texts = ["it's a  test, of 12 pieces.\n\nYes\t!", "", "  x", "été 3½ ...", "a\r\nb "]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(mixing._tokens(F.col("text")).alias("n")).collect()]
    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    assert got == [len(cut.pre_tokenize_str(t)) for t in texts]


def test_mix_repeats_documents(labelled):
    docs, labels = labelled
    extra = docs.withColumn("p", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    out = mixing.mix(extra, labels)
    assert out.columns == extra.columns and out.count() >= 0.9 * docs.count()
    assert mixing.mix(extra.where("1 = 0"), labels).count() == 0


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 20))
    vectors = [(i, (centres[i % 30] + 0.2 * rng.normal(size=20)).tolist()) for i in range(900)]
    vectors += [(1000 + i, vectors[100][1]) for i in range(30)]
    odd = [(5000, None), (5001, [0.0] * 20), (5002, [float("nan")] + [1.0] * 19), (5003, [None] + [1.0] * 19), (5004, [1.0, 2.0])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(table, table.where("vec_id % 100 = 0 OR vec_id > 4999"), block=100).collect()
    ids, matrix = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        hits, total = hits + len({r.vec_id for r in mine} & set(ids[best].tolist())), total + 10
        if q == 100:
            assert [r.vec_id for r in mine] == ids[best].tolist()
    assert hits >= 0.9 * total and {r.query_id for r in got} == set(ids[ids % 100 == 0].tolist())


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(table, table.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest_neighbours(table.where("1 = 0"), table).count() == 0


@pytest.mark.parametrize("n", [12, 20])
def test_short_queries_are_ranked_exactly(spark, n):
    matrix = np.random.default_rng(n).normal(size=(n, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)] + [(0, matrix[0].tolist())] * 9, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(table, table.distinct(), block=7).collect()
    assert len(got) == 10 * n
    if n == 12:  # the probes alone find about 5 of 11, so every query is short
        for q in range(n):
            far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in np.argsort(far) if i != q][:10]


def test_query_opposite_to_a_cluster(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    matrix = centre + 0.001 * rng.normal(size=(500, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    query = spark.createDataFrame([(1000, (-centre).tolist())], table.schema)
    got = ann.nearest_neighbours(table, query, block=100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == np.argsort(np.sqrt(((matrix + centre) ** 2).sum(1)))[:10].tolist()


@pytest.fixture(scope="module")
def pages(spark):
    long = "é<p>text</p>" * 200
    rows = [(1, "http://a", long), (2, "http://b", long), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "http://e", long + "x"), (2, "http://b", long), (None, "http://n", long)]
    rows += [(100 + i, f"http://{i}", hashlib.sha256(str(i).encode()).hexdigest() * 60) for i in range(40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_warc_round_trip(pages):
    rows = {r.page_id: r for r in warc.warc_round_trip(pages).collect() if r.page_id is not None}
    assert warc.warc_round_trip(pages).count() == pages.count()
    for p in pages.where("page_id IS NOT NULL").collect():
        data = (p.html or "").encode()
        assert (rows[p.page_id].payload_bytes, rows[p.page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (rows[1].record_type, rows[1].refers_to) == ("revisit", 2) and rows[2].record_type == rows[3].record_type == rows[6].record_type == "response"


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_every_record_has_one_owner(spark, pages, split):
    files = warc.write_warc(pages, shared_dir(spark, "warc-test"))
    records = warc.read_warc(files, split)
    assert records.count() == pages.count() == files.groupBy().sum("records").first()[0]
    assert records.select("path", "offset").distinct().count() == pages.count()


def test_damage_and_nested_archives(spark, tmp_path):
    inner = warc._record("9", "http://in", 6, b"inside", hashlib.sha1(b"inside").hexdigest(), None, "d")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    first = warc._record("1", "http://a", 3, b"one", hashlib.sha1(b"one").hexdigest(), None, "d")
    plain = zlib.decompress(warc._record("2", "http://b", len(inner), inner, hashlib.sha1(inner).hexdigest(), None, "d"), 31)
    nested = stored.compress(plain) + stored.flush()
    broken = bytearray(warc._record("3", "http://c", 495, b"three" * 99, hashlib.sha1(b"x").hexdigest(), None, "d"))
    broken[30:40] = b"\0" * 10
    last = warc._record("4", "http://d", 4, b"four", hashlib.sha1(b"four").hexdigest(), None, "d")
    data = first + nested + bytes(broken) + last
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data))], "path string, bytes long")
    for split in (64, 1 << 20):
        got = {r.page_id: bytes(r.payload) for r in warc.read_warc(files, split).collect()}
        assert got == {"1": b"one", "2": inner, "4": b"four"}


def test_no_pages(pages):
    assert warc.warc_round_trip(pages.where("1 = 0")).count() == 0


def test_text_ids_and_missing_responses(spark):
    page = "<p>hot page</p>" * 100
    names = ["null", "", "a b", "x>\r\ny", "é", "zz"]
    pages = spark.createDataFrame([(n, "http://h", page) for n in names] + [(None, None, "small")], "page_id string, url string, html string").repartition(3)
    rows = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    keeper = max(names)
    assert set(rows) == {*names, None} and all(r.payload_digest == hashlib.sha1((page if i is not None else "small").encode()).hexdigest() for i, r in rows.items())
    assert all((r.record_type, r.refers_to) == (("response", None) if i in (keeper, None) else ("revisit", keeper)) for i, r in rows.items())
    files = warc.write_warc(pages, shared_dir(spark, "warc-test"))
    assert warc.read_warc(files).where("record_type = 'revisit' AND length(payload) > 0").count() == 0
