import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, in_place
from tickloom.llm.exact_dedup import drop_exact_duplicates, find_exact_duplicates


def brute(docs):
    groups = {}
    for i, text in docs:
        key = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text or ""), i is None, i))
    out = []
    for key, rows in groups.items():
        keep = min(rows, key=lambda r: (r[0], r[1], r[2] or 0))[2]
        out += [(i, keep, len(rows), i == keep, key) for _, _, i in rows]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r[0], r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


DOCS = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(300)] + [(1000, None), (1001, ""), (1002, " \n"), (None, "text 1"), (None, "alone"), (1003, "x y"), (1004, "xy"), (1005, "word " * 40_000), (1006, "word" * 40_000)]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS _sha", "true AS kept")
    assert rows_of(find_exact_duplicates(df)) == brute(DOCS)


def test_false_positives_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH", 50)
    docs = [(i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(find_exact_duplicates(df, bits_per_key=1)) == brute(docs)


def test_drop_keeps_one_row_and_all_columns(spark):
    docs = DOCS + DOCS[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _sha", "array(1) AS keep_id")
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({k for _, k, *_ in brute(docs)}, key=str)
    # The one alone with a null id stays, and so does each group's best row.
    assert kept.count() == len({k for *_, k in brute(docs)})


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_exact_duplicates(empty).collect() == []
    assert drop_exact_duplicates(empty).collect() == []


def test_hot_text_over_many_files(spark, tmp_path):
    docs = [(i, "hot text" if i % 3 == 0 else f"t {i}" if i % 11 else f"twice {i % 2}") for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.struct(F.lit(1).alias("x")))
    df.repartition(13, "doc_id").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    kept = drop_exact_duplicates(stored, stored=True)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, *_ in brute(docs)})
    assert rows_of(find_exact_duplicates(stored)) == brute(docs)


def test_rows_meet_the_filter_where_they_lie(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "concat('t ', id % 700) AS text").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    key = F.xxhash64("text")
    repeats = exact_dedup.RepeatFilter(stored, key, 1000, 16)
    for kind in (True, False):
        plan = repeats.rows(stored, key, kind)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" in plan
    assert sorted(r.doc_id for r in repeats.rows(stored, key, False).collect()) == list(range(300, 700))


def test_passes_agree_on_what_is_marked_twice():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    label, block, h = np.sort(rng.integers(0, 4, 500)), rng.integers(0, 3, 500), rng.integers(-(2**62), 2**62, 500)
    batch = pa.RecordBatch.from_arrays([pa.array(label), pa.array(block), pa.array(h)], ["l", "b", "h"])
    marks = sorted((r for part in exact_dedup._marks(iter([batch.slice(0, 200), batch.slice(200)])) for r in part.to_pylist()), key=lambda r: r["block"])
    times, own = {}, {}
    for f, b, x in zip(label.tolist(), block.tolist(), h.tolist()):
        for k in range(exact_dedup.PROBES):
            slot = (b << 16) | ((x >> (16 * k)) & 0xFFFF)
            times[slot] = times.get(slot, 0) + 1
            own.setdefault(f, set()).add(slot)
    got = {}
    for b in exact_dedup._merge(iter([pa.RecordBatch.from_pylist(marks)])):
        for r in b.to_pylist():
            got.setdefault(r["label"], set()).update(np.frombuffer(r["keys"], in_place.KEY)["a"].tolist())
    assert got == {f: {s for s in slots if times[s] > 1} for f, slots in own.items()}
