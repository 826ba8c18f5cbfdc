import re
import zlib

import numpy as np
import pytest

from tickloom.llm import quality, toxicity
from tickloom.llm.common import learns
from tickloom.llm.quality import STATISTICS, document_statistics, isotonic, keep_good, score_quality
from tickloom.llm.toxicity import BITS, fit_toxicity, ngram_buckets, score_toxicity
from pyspark.sql import functions as F

D = "/root/testdata/sf0.1"


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(scored, labels, label, folds, fold):
    rows = scored.join(labels.select("doc_id", label), "doc_id").where(~learns(F.col("doc_id"), folds, fold)).collect()
    return np.array([r[label] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def test_toxicity_holds_out_of_fold(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    y, s, p = held_out(score_toxicity(docs, fit_toxicity(docs, labels)), labels, "toxic", 5, 0)
    assert area(y, s) > 0.97 and (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 0).mean() > 0.96


def test_quality_holds_out_of_fold(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    scored = score_quality(docs, labels)
    y, s, p = held_out(scored, labels, "quality", 3, 1)
    assert area(y, s) > 0.97 and (p == y).mean() > 0.96 and (p[y == 1] == 1).mean() > 0.97
    kept = {r.doc_id for r in keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in scored.where("predicted = 1").collect()}


def test_odd_rows_get_scores(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "stupid " * 30_000), (4, "again"), (5, "퟿😀")], "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS y")
    for labels in ([], [(1, 0, 0), (2, 0, 0)], [(i, int(i % 2), int(i % 2)) for i in range(1, 6)] + [(None, 1, 1), (4, None, None), (4, 1, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for scored in (score_toxicity(docs, fit_toxicity(docs, known)), score_quality(docs, known)):
            rows = scored.collect()
            assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert keep_good(docs, known).columns == docs.columns
    empty = docs.limit(0)
    assert score_quality(empty, known).collect() == [] and score_toxicity(empty, fit_toxicity(empty, known)).collect() == []


def slow_bucket(gram):
    """A character n-gram's bucket in plain integers."""
    word = (1 << 32) - 1
    codes = [ord(c) * 0x9E3779B1 & word for c in gram]
    h = codes[0]
    for c in codes[1:]:
        h = (h * 0x01000193 & word) ^ c
    h ^= h >> 15
    return (h * (0x85EBCA6B + 2 * len(gram)) & word) >> (32 - BITS)


def slow_buckets(text):
    clean = re.sub("[\x20\x09-\x0d]+", " ", f" {text.replace(chr(0x3A3), chr(0x3C3)).lower()} ")
    return sorted({slow_bucket(clean[i : i + k]) for k in (4, 5) for i in range(len(clean) - k + 1)})


def newton(x, y, penalty):
    """Logistic regression with an intercept that is not penalized, solved to the end."""
    x = np.c_[x, np.ones(len(x))]
    w, p = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 0]
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x + np.diag(p + 1e-12), x.T @ (m - y) + p * w)
    return w[:-1], w[-1]


def test_toxicity_is_the_plain_fit(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(["you", "are", "kind", "fine", "a"] + ["stupid", "idiot"] * (i % 4 == 0), int(rng.integers(3, 30))))) for i in range(200)]
    labels = [(i, int(i % 4 == 0 and i % 28 > 0)) for i in range(200)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(df, fit_toxicity(df, known, features=300)).collect()}
    half = {r.doc_id: r.half for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'half'), 2) AS half").collect()}
    own = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    y, h, sets = np.array([labels[i][1] for i in own], float), np.array([half[i] for i in own]), [slow_buckets(docs[i][1]) for i in own]
    seen = np.zeros((len(own), 1 << BITS))
    for k, s in enumerate(sets):
        seen[k, s] = 1

    def ratio(rows):
        share = [(seen[rows & (y == c)].sum(0) + 1) / ((rows & (y == c)).sum() + 2) for c in (0, 1)]
        return np.log(share[1] / share[0])

    everyone = np.ones(len(own), bool)
    doubt = np.sqrt(sum(1 / (seen[y == c].sum(0) + 1) for c in (0, 1)))
    top = np.argsort(-np.abs(ratio(everyone)) / doubt, kind="stable")[:300]
    top = np.array(sorted(t for t in top if seen[:, t].any()))
    w, b = newton(seen[:, top] * ratio(everyone)[top], y, 1.0)
    apart = np.zeros(len(own))
    for k in (0, 1):
        scale = ratio(h == k)[top]
        wk, bk = newton(seen[h == k][:, top] * scale, y[h == k], 1.0)
        apart[h != k] = seen[h != k][:, top] * scale @ wk + bk
    f1 = [(2 * y[apart >= t].sum() / ((apart >= t).sum() + y.sum()), -t) for t in apart]
    at = -max(f1)[1]
    below = max((a for a in apart if a < at), default=at)
    weights = np.zeros(1 << BITS)
    weights[top] = w * ratio(everyone)[top]
    want = {i: 1 / (1 + np.exp(-(weights[slow_buckets(t)].sum() + b - (at + below) / 2))) for i, t in docs}
    assert max(abs(got[i] - want[i]) for i in want) < 5e-3


def test_quality_is_the_plain_fit(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["river", "Stone.", "light", "over"] if i % 2 else ["$$", "BUY", "now!", "river"], int(rng.integers(3, 60))))) for i in range(400)]
    labels = [(i, int(i % 2) if i % 9 else int(rng.integers(0, 2))) for i in range(400)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in score_quality(df, known).collect()}
    calibrates = {r.doc_id: r.c for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4) = 0 AS c").collect()}
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([document_statistics(docs[i][1]) for i in own]), np.array([labels[i][1] for i in own], float)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-6] = 1
    rng = np.random.default_rng(5)
    frequencies, phases = rng.normal(size=(len(STATISTICS), 256)) * np.sqrt(0.24), rng.uniform(0, 2 * np.pi, 256)
    features = lambda x: np.c_[np.sqrt(2 / 256) * np.cos(np.clip((x - mean) / spread, -6, 6) @ frequencies + phases), np.ones(len(x))]
    cal = np.array([calibrates[i] for i in own])
    z = features(x[~cal])
    w = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.diag(np.r_[np.ones(256), 1e-9]) + 1e-9 * np.eye(257), z.T @ y[~cal])
    raw = lambda x: np.clip(features(x) @ w, -0.5, 1.5)
    place = np.minimum(((raw(x[cal]) + 0.5) / 2 * 2000).astype(int), 1999)
    bins = sorted(set(place.tolist()))
    good, n = [y[cal][place == b].sum() for b in bins], [(place == b).sum() for b in bins]
    # Isotonic shares as the largest over starts of the least over ends of the mean between.
    shares = [max(min(sum(good[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    edges = (np.array(bins) + 0.5) / 1000 - 0.5
    every = raw(np.array([document_statistics(t) for _, t in docs]))
    want = 0.999 * np.interp(every, edges, shares) + 0.001 * (every + 0.5) / 2
    assert np.abs(np.array([got[i] for i, _ in docs]) - want).max() < 1e-5


def test_labels_other_than_0_and_1_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} of {i}") for i in range(60)], "doc_id long, text string")
    plain = [(i, i % 2, i % 2) for i in range(1, 50)]
    for odd in ([], [(50, 2, 2), (51, -1, -1), (52, None, None), (3, 7, 7)]):
        known = spark.createDataFrame(plain + odd, "doc_id long, quality int, toxic int")
        rows = [sorted((r.doc_id, r.score) for r in f.collect()) for f in (score_toxicity(docs, fit_toxicity(docs, known)), score_quality(docs, known))]
        first = first if odd else rows
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for x, y in zip(rows, first) for a, b in zip(x, y))


@pytest.mark.parametrize("size", [5, 7, 64])
def test_chunks_change_nothing(monkeypatch, size):
    texts = ["", " ", "a", "ab  cd\n\n\n ef ", "  lead", "tail   ", "ΑΣ ΣΑΣ σς İx", "x" * 30, " \t" * 20 + "y", "one two  three " * 9, "😀é" * 20]
    whole = [ngram_buckets(t).tolist() for t in texts]
    assert whole == [slow_buckets(t) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", size)
    assert [ngram_buckets(t).tolist() for t in texts] == whole
    stats = [document_statistics(t) for t in texts]
    monkeypatch.setattr(quality, "SLICE", size)
    assert np.allclose([document_statistics(t) for t in texts], stats, atol=1e-12)


def test_ngrams_see_the_whole_text():
    text = " ab cde "
    assert len(ngram_buckets("Ab\n\n cDe", (4,))) <= len(text) - 3
    assert set(ngram_buckets("Ab\n\n cDe")) == set(ngram_buckets("ab cde"))
    far = ngram_buckets("a" * 300_000 + " rare")
    assert set(ngram_buckets("rare", (5,))) & set(far) and far.max() < 1 << BITS


@pytest.mark.parametrize("text", ["", "a", "A b\nA b\n", "\x00\x01", "é" * 10])
def test_statistics_are_finite(text):
    x = document_statistics(text)
    assert len(x) == len(STATISTICS) and np.isfinite(x).all()


def test_isotonic_pools():
    got = isotonic(np.array([1.0, 0, 0, 3, 2, 5]), np.array([2.0, 2, 0, 4, 4, 5]))
    assert np.isnan(got[2]) and np.allclose(got[[0, 1, 3, 4, 5]], [0.25, 0.25, 0.625, 0.625, 1])


def test_a_labelled_id_in_many_rows_keeps_the_sample_small(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    many = spark.range(3000).selectExpr("CAST(7 AS long) AS doc_id", "concat('other ', id % 1000) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    chosen = toxicity.sampled_labels(labels, "toxic", "doc_id", 5, 0, 100)
    texts = [sorted(r._text for r in toxicity.sampled_texts(docs.union(many).repartition(n), chosen, "doc_id", "text", 100).collect()) for n in (2, 7)]
    assert len(texts[0]) == 100 == len(set(texts[0])) and texts[0] == texts[1]
