import numpy as np
import pytest

from tickloom.llm import shingle_sets, simhash


def words_of(rng, n):
    return [f"w{i}" for i in rng.integers(0, 5000, n)]


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, similarity=0.8):
    """The ids that stay, of each group the smallest."""
    sets = [shingles(t) for _, t in docs]
    fps = np.array([simhash.fingerprint((t or "").encode(), 5) for _, t in docs], np.uint64)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            alike = union and len(sets[i] & sets[j]) / union >= similarity
            if alike or bin(int(fps[i] ^ fps[j])).count("1") <= 3:
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values())


def kept(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS s", "2 AS bands", "3 AS n").repartition(3)
    out = simhash.drop_near_duplicates(df, shingle=5, similarity=0.8, **more)
    assert out.columns == df.columns
    return sorted(r.doc_id for r in out.collect())


def test_planted_copies_match_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = []
    for g in range(60):
        base = words_of(rng, int(rng.choice([40, 150, 600])))
        for _ in range(int(rng.integers(1, 4))):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 25))):
                w[k] = f"z{rng.integers(0, 99)}"
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    want = brute(docs)
    assert 60 <= len(want) < len(docs) - 20
    assert kept(spark, docs) == want
    alone = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5).count()
    assert alone > len(want)


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = words_of(rng, 300)
    docs = [(i, " ".join(f"v{i}" if k == i % 300 or k == (7 * i) % 300 else w for k, w in enumerate(base))) for i in range(1, 400)]
    docs += [(i, " ".join(words_of(rng, 60))) for i in range(1000, 1100)]
    assert kept(spark, docs) == [1, *range(1000, 1100)]


def test_texts_that_share_a_passage_stay(spark):
    rng = np.random.default_rng(6)
    passage = words_of(rng, 100)
    docs = [(i, " ".join(passage + words_of(rng, 80))) for i in range(40)]
    assert kept(spark, docs) == brute(docs) == list(range(40))


def test_nulls_empty_short_and_repeats(spark):
    docs = [(9, None), (8, ""), (7, "  "), (5, "One two"), (6, "one  TWO"), (4, "one two three"), (3, "a b c d e " * 30), (2, "a b c d e " * 50), (1, "x y"), (1, "x y")]
    # 2 and 3 have the same set of shingles, and 7 to 9 none.
    assert kept(spark, docs) == [1, 2, 4, 5, 7]
    assert kept(spark, []) == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in simhash.drop_near_duplicates(odd, shingle=5, similarity=0.8).collect()} == {(2, "a b c d e f"), (None, None)}


def edited(rng, base, edits, mark):
    """A copy with ``edits`` words replaced, far enough from each other that each changes five shingles."""
    w = list(base)
    for k in 4 + 6 * rng.permutation((len(base) - 8) // 6)[:edits]:
        w[k] = f"{mark}x{k}"
    return w


def test_a_page_and_its_edited_copies(spark):
    """Copies are at 0.818 to the page, and at most 0.78 to each other: only the page links them."""
    rng = np.random.default_rng(7)
    page = [f"p{i}" for i in range(204)]
    docs = [(i, " ".join(page if i == 300 else edited(rng, page, 4, f"c{i}"))) for i in range(601)]
    for partitions in ("4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert kept(spark, docs) == [0]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_without_their_page_stay(spark):
    rng = np.random.default_rng(8)
    page = [f"p{i}" for i in range(204)]
    docs = [(i, " ".join(edited(rng, page, 5, f"c{i}"))) for i in range(150)]
    assert kept(spark, docs) == brute(docs)


def test_two_pages_of_one_passage_and_chains(spark, monkeypatch):
    """Groups that share buckets, and chains whose ends are no copies; small blocks."""
    monkeypatch.setattr(shingle_sets, "BLOCK", 16)
    monkeypatch.setattr(shingle_sets, "SENT", 8)
    rng = np.random.default_rng(9)
    passage, docs = [f"p{i}" for i in range(120)], []
    for g in range(2):
        page = passage + words_of(rng, 80)
        docs += [(len(docs) + i, " ".join(edited(rng, page, 3, f"g{g}c{i}"))) for i in range(60)]
    for g in range(40):
        w = words_of(rng, 300)
        for step in range(8):
            docs.append((len(docs), " ".join(w)))
            w = w[18:] + [f"s{g}x{step}x{i}" for i in range(18)]
    want, got = brute(docs), kept(spark, docs)
    assert set(want) <= set(got) and len(got) <= len(want) + 2
    assert len(want) < len(docs) / 4


@pytest.mark.parametrize("block,items", [(512, 1 << 19), (16, 1 << 19), (512, 1500)])
def test_rows_do_not_grow_with_pairs(spark, monkeypatch, block, items):
    """A bucket of many pairs that are alike or nearly so sends links that connect them, not the pairs."""
    monkeypatch.setattr(shingle_sets, "ITEMS", items)
    rng = np.random.default_rng(11)
    # Three groups of 40 copies without a page: pairs at 0.72 to 0.92, and pairs of two groups at 0.6 or so.
    common, members = rng.integers(0, 1 << 63, 80, np.uint64), {}
    for g in range(3):
        page = np.r_[common, rng.integers(0, 1 << 63, 20, np.uint64)]
        for _ in range(40):
            keep = np.delete(page, rng.permutation(100)[: int(rng.integers(2, 9))])
            members[len(members)] = np.unique(np.r_[keep, rng.integers(0, 1 << 63, 100 - len(keep), np.uint64)])
    label = {s: s - s % 2 for s in members}
    parent = dict(label)

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    pairs = [(a, b) for a in members for b in members if a < b and label[a] != label[b] and shingle_sets.similarity_of(members[a], members[b]) >= 0.8]
    for a, b in pairs:
        parent[root(a)] = root(b)
    shared = spark.createDataFrame([(k, s, len(x)) for k in range(2) for s, x in members.items()], "key long, s long, n long")
    labels = spark.createDataFrame(list(label.items()), "s long, label long")
    marks = spark.createDataFrame([(s, bytearray(shingle_sets.marks_of(shingle_sets.least_hashes(x)))) for s, x in members.items()], "s long, marks binary")
    sets = spark.createDataFrame([(s, bytearray(x.tobytes())) for s, x in members.items()], "s long, items binary")
    got = [tuple(r) for r in shingle_sets.unlinked_links(shared, labels, marks, sets, 0.8, block).collect()]
    blocks = max(-(-120 // block), -(-sum(map(len, members.values())) // items))
    assert len(pairs) > 1000 and set(got) <= set(pairs) and len(got) <= 2 * 120 * (blocks + 1)
    again = dict(label)

    def root_of(s):
        while again[s] != s:
            s = again[s]
        return s

    for a, b in got:
        again[root_of(a)] = root_of(b)
    assert len({(root(s), root_of(s)) for s in members}) == len({root(s) for s in members}) == len({root_of(s) for s in members})


@pytest.mark.parametrize("low,high", [(0.8, 0.85), (0.85, 1.0)])
def test_recall_of_pairs(spark, low, high):
    rng = np.random.default_rng(10)
    docs, pairs = [], 0
    while pairs < 400:
        base = words_of(rng, int(rng.choice([100, 300])))
        copy = edited(rng, base, int(rng.integers(1, len(base) // 30 + 1)), "z")
        x, y = shingles(" ".join(base)), shingles(" ".join(copy))
        if low <= len(x & y) / len(x | y) < high:
            docs += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(copy))]
            pairs += 1
    assert len(kept(spark, docs)) <= pairs * 1.02


@pytest.mark.parametrize("size", [3, 64])
def test_slices_and_similarity(size):
    text = b" ".join(b"w%d" % (i % 97) for i in range(500))
    whole = shingle_sets.shingle_set(list(shingle_sets.shingle_hashes(text, 5)))
    assert (shingle_sets.shingle_set(list(shingle_sets.shingle_hashes(text, 5, size))) == whole).all()
    x, y = np.arange(0, 9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert shingle_sets.similarity_of(x, y) == shingle_sets.similarity_of(y, x) == 8 / 10
    assert shingle_sets.similarity_of(x[:0], y) == 0 and shingle_sets.bands_of(x[:0]) == b""
    assert len(shingle_sets.bands_of(whole)) == 8 * shingle_sets.BANDS
    assert len(shingle_sets.marks_of(shingle_sets.least_hashes(whole))) == shingle_sets.BANDS * shingle_sets.DEPTH


@pytest.mark.parametrize("heavy", [10, 1000])
def test_only_shared_rows_leave_the_join_with_large_buckets(spark, monkeypatch, heavy):
    rng, plans, written = np.random.default_rng(3), {}, shingle_sets.materialize

    def recorded(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(shingle_sets, "materialize", recorded)
    monkeypatch.setattr(shingle_sets, "HEAVY", heavy)
    # 60 sets that share most bands (large buckets), 30 in pairs, 200 alone.
    keys = [[j if j < 15 else 1000 + 20 * i + j for j in range(20)] for i in range(60)]
    keys += [[5000 + 20 * (i // 2) + j if j < 3 else 10_000 + 20 * i + j for j in range(20)] for i in range(30)]
    keys += [rng.integers(1 << 40, 1 << 50, 20).tolist() for _ in range(200)]
    rows = [(s, 7, np.array(k, np.int64).tobytes(), b"") for s, k in enumerate(keys)]
    got = shingle_sets.shared_buckets(spark.createDataFrame(rows, "s long, n long, bands binary, marks binary")).collect()
    members = {}
    for s, own in enumerate(keys):
        for k in own:
            members.setdefault(k, []).append(s)
    shared = {k: m for k, m in members.items() if len(m) > 1}
    deg = {s: sum(len(shared[k]) for k in own if k in shared) for s, own in enumerate(keys)}
    assert sorted((r.key, r.s, r.n, r.many, r.deg) for r in got) == sorted((k, s, 7, len(m), deg[s]) for k, m in shared.items() for s in m)
    assert "LeftOuter" not in plans["buckets"]
