"""The audit against its SQL, and against plain counts on planted cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oracle import assert_same, connect
from tickloom.llm import divergence, queries
from tickloom.llm.divergence import share, source_divergence

D = "/root/testdata/sf0.001"
SCHEMA = "lang string, source string, text string, term string, n long"


def plain(rows, least=3, most=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        size = lambda c: sum(c[t] for t in kept)
        share = lambda c, n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        sources = [s for l, s in groups if l == lang]
        p = {s: share(counts[lang, s], size(counts[lang, s])) for s in sources}
        whole = sum((counts[lang, s] for s in sources), Counter())
        q = share(whole, size(whole))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(terms)[:most], 1)}
    return out


ROWS = (
    [("en", "a", "Apple banana apple", "x", 1)] * 5
    + [("en", "b", "banana CHERRY Ärger ärger\U0001f600", None, 2)] * 4
    + [("en", None, "apple-apple_apple1apple", "y", 3), ("en", "", "cherry", "y", 3), ("en", "empty", None, "z", 4), ("en", "empty", "", "z", 4)]
    + [(None, "a", "only two", "x", 1)] * 2
    + [("", "b", None, "x", 1), ("de", "a", "einzeln", "x", 1)]
    + [("en", "long", "banana " * 20_000, "x", 1)]
    + [("fr", f"s{i}", " ".join(f"w{chr(97 + j)}" for j in range(i % 5 + 1)), "x", 1) for i in range(20)]
)


def got(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_planted_cases(spark, broadcast_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(source_divergence(df, broadcast_rows=broadcast_rows)) == plain(ROWS)
    assert got(source_divergence(df, least_docs=1, most_terms=2, broadcast_rows=broadcast_rows)) == plain(ROWS, 1, 2)


def test_shares_are_exact_at_any_size(spark):
    rows = [(0, 0, 1), (8_999_999_999, 10**12, 7), (9_000_000_001, 10**10, 3), (9 * 10**17, 10**18, 5), (0, 0, 0)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").select("n", "total", "terms", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + v) if t + v else None for n, t, v in rows]


def test_counts_handed_on_early_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 0)
    assert got(source_divergence(spark.createDataFrame(ROWS, SCHEMA))) == plain(ROWS)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_against_sql(spark):
    assert_same(queries.op13_source_divergence(spark, D), connect(D), queries.oracle_sql()["op13_source_divergence"])


def test_dense_rows_are_not_shuffled(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = source_divergence(df)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("SortMergeJoin [lang")
    assert "REPARTITION_BY_COL" in plan[at:] and plan[at:].count("hashpartitioning(lang#") >= 1
    assert "WindowGroupLimit" in plan
