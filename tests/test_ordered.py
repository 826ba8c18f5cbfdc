"""Numbers, previous rows and ranks over blocks and counted values, against pandas."""

import time
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import classification, normalize, regression, resample
from tickloom.sources import ticks
from tickloom.sources.shared import materialize, scratch, shared_path


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ticks, "BLOCK", 8)


def days(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for day, n in (("a", 100), ("b", 1), ("c", 57)):
        seqs = np.sort(rng.choice(300, n, replace=False))  # with gaps of whole blocks
        rows += [(day, int(s), int(rng.integers(0, 3)), int(rng.integers(0, 3)), None if rng.random() < 0.1 else float(rng.normal())) for s in seqs]
    return pd.DataFrame(rows, columns=["day", "seq", "label", "pred", "x"])


def test_numbers_run_on_over_blocks_and_days(spark, small_blocks):
    pdf = days()
    got = ticks.numbered(spark.createDataFrame(pdf).repartition(5)).orderBy("day", "seq").toPandas()
    assert got["i"].tolist() == list(range(len(pdf)))


def test_row_before_reaches_over_gaps(spark, small_blocks):
    pdf = days(1)
    df = spark.createDataFrame([tuple(None if v != v else v for v in row) for row in pdf.itertuples(index=False)], "day string, seq long, label long, pred long, x double")
    got = ticks.row_before(df, "x", "before").orderBy("day", "seq").toPandas()
    np.testing.assert_array_equal(got["before"].to_numpy(float), pdf.groupby("day")["x"].shift().to_numpy(float))
    changed = pdf[pdf["label"] != pdf.groupby("day")["label"].shift().fillna(pdf["label"])]
    one = classification.transition_accuracy(df).first()
    assert one.n_transitions == len(changed) and one.transition_accuracy == pytest.approx((changed["label"] == changed["pred"]).mean())


def test_no_window_is_keyed_by_day_alone(spark):
    rows = spark.createDataFrame(days())
    for df in (ticks.numbered(rows), ticks.row_before(rows, "x", "before"), normalize.zscore_per_day(rows, "x", "z")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # Such windows are left over the aggregated rows of blocks only.
        for line in plan.splitlines():
            if "Window" in line and "_own" not in line.split("Window", 1)[1]:
                assert "_n" in line


def test_zscore_per_day(spark):
    pdf = days(2).dropna()
    got = normalize.zscore_per_day(spark.createDataFrame(pdf), "x", "z").orderBy("day", "seq").toPandas()
    want = pdf.groupby("day")["x"].transform(lambda x: (x - x.mean()) / (x.std(ddof=0) or 1.0))
    np.testing.assert_allclose(got["z"], want, atol=1e-12)


def test_a_value_in_a_third_of_the_rows_is_spread(spark):
    """Rows of a heavy value meet its rank where they lie: no task of the join gets them all."""
    n = 60_000
    df = spark.range(n, numPartitions=8).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = regression.average_ranks(df, "x", [], "r")
        sizes = ranked.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().toPandas()["count"]
        got = ranked.toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes.max() < n / 3
    np.testing.assert_allclose(got["r"], got["x"].rank())


def test_ranks_by_group_with_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), None if rng.random() < 0.1 else float(rng.integers(0, 9))) for g in rng.integers(0, 4, 500)]
    got = regression.average_ranks(spark.createDataFrame(rows, "g int, x double"), "x", ["g"], "r", buckets=8).toPandas()
    np.testing.assert_allclose(got["r"].to_numpy(float), got.groupby("g")["x"].rank().to_numpy(float))
    assert len(got) == 500


def test_replicates_ranked_anew(spark):
    """Each replicate's rank correlation is that of its own rows, as often as they were drawn."""
    n, length, replicates, seed = 90, 7, 30, 5
    rng = np.random.default_rng(4)
    y = rng.integers(0, 12, n).astype(float)
    p, q = np.round(y + rng.normal(0, 4, n)), rng.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), float(p[i]), float(q[i])) for i in range(n)], "i long, y double, p double, q double")
    got = {(r.replicate, r.treatment): r.ic for r in resample.replicate_correlations(df, "y", ["p", "q"], n, length, replicates, seed).collect()}
    starts = spark.range(replicates).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // length) - 1))).alias("at"))
    starts = starts.select("r", resample.draw(F.col("r"), F.col("at"), seed, F.lit(n - length + 1).cast("long")).alias("s")).toPandas()
    for r in range(replicates):
        rows = np.concatenate([np.arange(s, s + length) for s in starts[starts["r"] == r]["s"]])
        for name, x in (("p", p), ("q", q)):
            assert got[r, name] == pytest.approx(pd.Series(y[rows]).rank().corr(pd.Series(x[rows]).rank()))


def test_replicate_sums_are_those_of_the_drawn_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "SPAN", 64)
    n, length, replicates, seed = 500, 7, 120, 5
    x = [(-1.0) ** k * (k % 13) for k in range(n)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "i long, x double").repartition(3)
    starts = resample.drawn_starts(spark, n, length, replicates, seed).collect()
    want = [0.0] * replicates
    for r in starts:
        want[r.replicate] += sum(x[r.start : r.start + length])
    assert len(starts) == replicates * 72
    got = {r.replicate: r.s for r in resample.replicate_sums(df, {"s": F.col("x")}, n, length, replicates, seed).collect()}
    assert got == pytest.approx(dict(enumerate(want)))


def test_many_draws_are_not_broadcast(spark):
    n, length = 1_000_000, 100
    rows = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"))
    got = resample.replicate_sums(rows, {"s": F.col("x")}, n, length, 1000, 42)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("replicates", [30, 300])
def test_replicates_ranked_anew_over_many_buckets(spark, monkeypatch, replicates):
    """Buckets, a value in most rows, rows without a value and several batches give the ranks of the rows drawn."""
    from tickloom.operators import reranked

    monkeypatch.setattr(reranked, "SPAN", 16)
    n, length, seed = 400, 9, 3
    rng = np.random.default_rng(8)
    y = np.where(rng.random(n) < 0.5, 2.0, np.round(rng.normal(2, 3, n), 1))
    p, q = np.where(rng.random(n) < 0.3, 0.0, y + rng.normal(0, 2, n)), rng.integers(0, 5, n).astype(float)
    q[::11] = np.nan
    df = spark.createDataFrame([(i, float(y[i]), float(p[i]), None if np.isnan(q[i]) else float(q[i])) for i in range(n)], "i long, y double, p double, q double")
    got = {(r.replicate, r.treatment): r.ic for r in resample.replicate_correlations(df, "y", ["p", "q"], n, length, replicates, seed).collect()}
    starts = pd.DataFrame(resample.drawn_starts(spark, n, length, replicates, seed).collect(), columns=["r", "s"])
    assert len(got) == 2 * replicates
    for r in range(replicates):
        rows = np.concatenate([np.arange(s, s + length) for s in starts[starts["r"] == r]["s"]])
        for name, x in (("p", p), ("q", q)):
            own = rows[~np.isnan(x[rows])]
            assert got[r, name] == pytest.approx(pd.Series(y[own]).rank().corr(pd.Series(x[own]).rank()))


def shared_tables(spark):
    """Names of the tables in the shared folder, without their random ends."""
    return [p.name.rsplit("-", 1)[0] for p in Path(shared_path(spark, "x")).parent.glob("*")]


def test_replicates_in_batches_leave_no_rows_on_disk(spark, monkeypatch):
    """Replicates taken a few at a time are the same, and the tables of rows are gone at the end, which grow with rows x replicates."""
    from tickloom.operators import reranked

    rng = np.random.default_rng(6)
    n, length, replicates, seed = 300, 7, 60, 5
    rows = spark.createDataFrame([(i, float(rng.integers(0, 30)), float(rng.normal()), float(rng.normal())) for i in range(n)], "i long, y double, p double, q double")
    correlations = lambda: {(r.replicate, r.treatment): r.ic for r in resample.replicate_correlations(rows, "y", ["p", "q"], n, length, replicates, seed).collect()}
    want = correlations()
    monkeypatch.setattr(reranked, "HELD", 20 * n)
    assert reranked.batches(n, replicates) == [(0, 20), (20, 20), (40, 20)]
    assert correlations() == pytest.approx(want) and len(want) == 2 * replicates
    assert not {"replicates-of-y", "rows-in-chunks"} & set(shared_tables(spark))


def test_batches_hold_fewer_replicates_of_more_rows():
    from tickloom.operators.reranked import BATCH, HELD, LEAST, batches

    for n, replicates in ((0, 5), (1000, 200), (36_000_000, 200), (10**10, 10_000)):
        got = batches(n, replicates)
        assert [k for a, width in got for k in range(a, a + width)] == list(range(replicates))
        assert max(width for _, width in got) <= max(LEAST, min(BATCH, HELD // max(n, 1)))


def test_equal_rows_travel_once(spark, monkeypatch):
    """Rows that are equal in all ranks leave their bucket of y as one, however often they occur and wherever they lie."""
    from tickloom.operators import reranked

    monkeypatch.setattr(reranked, "SPAN", 64)
    counts, real = [], reranked.scratch

    @contextmanager
    def seen(df, tag):
        with real(df, tag) as table:
            if tag == "replicates-of-y":
                counts.append((table.where("total IS NULL").count(), table.where("total IS NOT NULL").count()))
            yield table

    monkeypatch.setattr(reranked, "scratch", seen)
    n, length, replicates, seed = 6000, 19, 10, 5
    rng = np.random.default_rng(7)
    kinds = rng.integers(0, 12, n)
    y, p = (kinds % 4).astype(float), (kinds * 5 % 7).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), float(p[i])) for i in range(n)], "i long, y double, p double")
    got = {r.replicate: r.ic for r in resample.replicate_correlations(df, "y", ["p"], n, length, replicates, seed).collect()}
    # Twelve different rows; a bucket of y for each of the parts that its four values are dealt to.
    assert [c for c, _ in counts] == [12] and counts[0][1] <= 12
    starts = pd.DataFrame(resample.drawn_starts(spark, n, length, replicates, seed).collect(), columns=["r", "s"])
    for r in range(replicates):
        rows = np.concatenate([np.arange(s, s + length) for s in starts[starts["r"] == r]["s"]])
        assert got[r] == pytest.approx(pd.Series(y[rows]).rank().corr(pd.Series(p[rows]).rank()))


@pytest.mark.parametrize("width", [1, 2, 3, 29])
@pytest.mark.parametrize("top", [0, 15, 16, 255, 256, 65535, 65536, (1 << 31) - 1, 1 << 31])
def test_counts_travel_in_few_bits(width, top):
    from tickloom.operators.reranked import packed, unpacked

    x = np.random.default_rng(1).integers(0, top, (40, width), endpoint=True)
    x[0, -1] = top
    first, second = packed(x), packed(np.minimum(x[:7], 3))
    got = unpacked(pa.chunked_array([first, second, second[3:]]), width)
    np.testing.assert_array_equal(got, np.concatenate([x, np.minimum(x[:7], 3), np.minimum(x[3:7], 3)]))
    assert len(second[0].as_py()) == (width + 1) // 2 and len(first[0].as_py()) == {0: (width + 1) // 2, 15: (width + 1) // 2, 16: width, 255: width}.get(top, len(first[0].as_py()))


def test_a_written_table_leaves_no_shuffle(spark):
    """Shuffles are dropped once their table is written, in place of at some later collection of the driver's memory."""
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
    df = spark.range(20_000).groupBy((F.col("id") % 5003).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = blocks()
    got = materialize(df, "counted")
    for _ in range(50):
        if blocks() <= before:
            break
        time.sleep(0.2)
    assert blocks() <= before and got.agg(F.sum("n")).first()[0] == 20_000
    with scratch(got, "scratch") as table:
        assert table.count() == 5003 and "scratch" in shared_tables(spark)
    assert "scratch" not in shared_tables(spark)


def test_no_task_ranks_all_pairs_of_a_frequent_value(spark):
    """Half the rows share one y, all with different x: the rank of y is taken over counted values, and its rows are not one task's."""
    n = 40_000
    df = spark.range(n, numPartitions=8).select(F.rand(2).alias("x"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1)).alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"))
    df = df.withColumn("x", F.col("x") + F.col("y") / 2)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/frequent")
    df = spark.read.parquet(path)
    seen = []
    real = regression._ranked

    def ranked(rows, value, *more):
        seen.append(rows.groupBy("_g", value).count().agg(F.max("count")).first()[0])
        return real(rows, value, *more)

    regression._ranked = ranked
    try:
        got = {r.g: (r.ic, r.n) for r in regression.spearman(df, "x", "y", ["g"]).collect()}
    finally:
        regression._ranked = real
    assert seen == [1, 1]
    pdf = df.toPandas()
    for g, own in pdf.groupby(pdf["g"].fillna(-1)):
        ic, count = got[None if g == -1 else int(g)]
        assert count == len(own) and ic == pytest.approx(own["x"].rank().corr(own["y"].rank()))
