from pyspark.sql import functions as F

from tickloom.llm.common import in_filter
from tickloom.llm.line_dedup import drop_repeated_lines

SPACES = " \t\n\x0b\f\r"


def brute(docs, spark, window=3):
    """Rows that repeat an id with another text are documents of their own, in the order of the texts' hashes."""
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t)").collect()}
    seen, dead = {}, {}
    for i, text in sorted(((i, t or "") for i, t in docs if i is not None), key=lambda d: (d[0], hashes[d[1]])):
        lines = [x.strip(SPACES) for x in text.split("\n")]
        lines = [x for x in lines if x]
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            if seen.setdefault(key, (i, text, p)) != (i, text, p):
                dead.setdefault((i, text), set()).update(range(p, p + window))
    out = []
    for i, text in docs:
        kept, n, gone = [], 0, dead.get((i, text or ""), ())
        for x in (text or "").split("\n"):
            if x.strip(SPACES):
                if n not in gone:
                    kept.append(x)
                n += 1
            else:
                kept.append(x)
        out.append((i, n, len(gone), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    passage = "one line\n  two line \n\nthree line\nfour line"
    docs = [(1, "a\n" + passage + "\nb"), (2, passage), (3, "x\n" + passage.replace("  two line ", "two line") + "\ny\nz"), (4, "l\n" * 9), (5, None), (6, ""), (7, "\n\n"), (8, "a\nb"), (None, passage), (9, passage), (9, passage), (10, "\n".join(f"line {k % 40}" for k in range(3000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS positions", "2 AS _id")
    got = sorted(((r.doc_id, r.n_lines, r.removed_lines, r.clean_text) for r in drop_repeated_lines(df).collect()), key=str)
    assert got == brute(docs, spark)


def test_rows_that_repeat_an_id_are_judged_apart(spark):
    docs = [(1, "a\nb\nc"), (2, "x\ny\nz"), (2, "a\nb\nc"), (None, "a\nb\nc"), (3, "x\ny\nz\nq")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.removed_lines, r.clean_text) for r in drop_repeated_lines(df).collect()), key=str)
    assert got == brute(docs, spark)
    assert (2, 3, 0, "x\ny\nz") in got and (2, 3, 3, "") in got and (3, 4, 3, "q") in got


def test_filter_has_no_false_negatives(spark):
    known = spark.range(0, 40_000, 7)
    got = in_filter(spark.range(40_000), F.col("id"), known).groupBy((F.col("id") % 7 == 0).alias("known"), "_maybe").count().collect()
    count = {(r.known, r._maybe): r["count"] for r in got}
    assert (True, False) not in count and count[False, True] < 0.05 * count[False, False]
    # A filter that is too small for its keys lets more through and loses none.
    small = in_filter(spark.range(40_000), F.col("id"), known, most_bytes=4096)
    assert small.where("id % 7 = 0 AND NOT _maybe").count() == 0


def test_empty(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
