import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash


def brute(docs):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in docs]
    f = np.array(fps, np.uint64)
    parent = list(range(len(f)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(docs)}


def slow_fingerprint(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "a B", "a b c", "É É x  y\tZ z z z z", "w " * 50, "Ab c\x1cd e f g\x85h i"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [4096, 5])
def test_components_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(25):
        words = list(rng.choice(vocabulary, 400))
        for _ in range(int(rng.integers(1, 9))):
            w = list(words)
            for k in rng.integers(0, len(w), int(rng.integers(0, 3))):
                w[k] = str(rng.choice(vocabulary))
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    docs += [(5000, None), (5001, ""), (5002, "  "), (5003, "one"), (5004, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df, block=block).collect()}
    want = brute(docs)
    assert got == want
    assert len({c for _, c in want.values()}) < len(docs) - 10
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df.selectExpr("*", "1 AS fp"), block=block).collect())
    assert kept == sorted({c for _, c in want.values()})


def test_empty_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (None, "zz"), (7, "a b c d"), (7, "a b c d")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.simhash_components(odd).collect()), key=str)
    assert got == [("7", 7), ("7", 7), ("None", 7), ("None", None)]


def test_rows_that_repeat_an_id_are_judged_apart(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (None, b, 1), (None, "z y x", 1), (None, "z y x", 2), (7, "m n", 3), (7, "m n", 3), (7, "m n", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = sorted((tuple(r) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert [r[:2] for r in kept] == [(1, a), (5, b), (7, "m n"), (None, "z y x")] and len({r[1] for r in kept}) == 4
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (None, 5), (None, None), (7, 7)}
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 13, 200])
def test_slices_change_nothing(monkeypatch, size):
    texts = [" ".join(f"w{i % 977}" for i in range(1000)), "  a\n b \t", "x" * 50 + " y", "a b", "a b c", "a\x0bb  c d " * 9, " " * 40]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert whole == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", size)
    assert [simhash.fingerprint(t.encode()) for t in texts] == whole


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (100, 95), (3, 3)], "u long, v long")
    got = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {90: 90, 95: 90, 100: 90}


@pytest.mark.parametrize("most", [4, 10])
def test_links_wider_than_the_grids_are_refused(spark, most):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at most 3 bits"):
        simhash.simhash_components(docs, most=most)


def test_edges_in_one_piece_settle_in_one_round(spark, monkeypatch):
    """A chain, a hub and loose pairs: each task puts stars in place of its edges, so that one round sees nothing change."""
    from tickloom.llm import components

    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000 + 2 * k, 5001 + 2 * k) for k in range(50)]
    df = spark.createDataFrame([(b, a) if a % 3 else (a, b) for a, b in edges], "u long, v long")
    want = {n: 0 for n in range(301)} | {1000 + k: 1000 for k in range(200)} | {5000 + k: 5000 + k - k % 2 for k in range(100)}
    assert {r.node: r.root for r in components.connected_components(df, most_rounds=1).collect()} == want
    monkeypatch.setattr(components, "PIECE", 7)
    assert {r.node: r.root for r in components.connected_components(df).collect()} == want


def test_few_edges_in_many_partitions_take_one_round(spark):
    """A chain dealt over many partitions, of which no task holds a long part."""
    from tickloom.llm import components

    edges = spark.range(900).selectExpr("(id * 7919) % 1009 AS u", "(id * 7919 + 7919) % 1009 AS v")
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in components.connected_components(edges, most_rounds=1).collect()}
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == {(i * 7919) % 1009: 0 for i in range(901)}
