"""Queries over sources, labels and sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.features import sequences
from ..operators.load import day_headers, load_split
from ..sources import ticks as S
from ..sources.day_files import write_day_files, write_metadata
from .fixtures import LABELED, TICKS, W, labeled, query, r


@query(f"WITH {TICKS} SELECT day, count(*) AS n_rows, {r('min(value)', 'min_value')}, {r('max(value)', 'max_value')}, strftime(min(ts), '%H:%M:%S') AS first_time, strftime(max(ts), '%H:%M:%S') AS last_time FROM ticks GROUP BY day")
def q_profile_days(spark, d):
    got = S.day_profile(S.ticks(spark, d))
    return got.select("day", "n_rows", "min_value", "max_value", F.date_format("first_ts", "HH:mm:ss").alias("first_time"), F.date_format("last_ts", "HH:mm:ss").alias("last_time"))


@query(f"WITH {TICKS}, days AS (SELECT day, percent_rank() OVER (ORDER BY day) AS p FROM (SELECT DISTINCT day FROM ticks)), named AS (SELECT day, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM days), spans AS (SELECT split, min(t.day) AS first_day, max(t.day) AS last_day, count(DISTINCT t.day) AS n_days FROM ticks t JOIN named USING (day) GROUP BY split) SELECT *, coalesce(first_day > lag(last_day) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END), TRUE) AS follows FROM spans")
def q_split_chronology(spark, d):
    from ..operators.validate import split_chronology

    return split_chronology(S.with_split(S.ticks(spark, d)))


@query(f"WITH {TICKS} SELECT day, seq, event_id FROM ticks WHERE day IN (SELECT DISTINCT day FROM ticks ORDER BY day LIMIT 3)")
def q_first_days(spark, d):
    return S.first_days(S.ticks(spark, d), 3).select("day", "seq", "event_id")


@query("SELECT count(*) AS n_rows, count(DISTINCT len(embedding)) AS n_widths, max(len(embedding)) AS width, count(DISTINCT label) AS n_labels FROM embeddings")
def q_dataset_info(spark, d):
    e = S.table(spark, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.size("embedding")).alias("n_widths"), F.max(F.size("embedding")).cast("long").alias("width"), F.countDistinct("label").alias("n_labels"))


@query(f"WITH {LABELED} SELECT day, seq, {r('y', 'y')} FROM labeled WHERE y IS NOT NULL")
def q_point_return_h10(spark, d):
    return labeled(spark, d).where("y IS NOT NULL").select("day", "seq", "y")


def _frame(value: str, low: int, high: int) -> str:
    side = lambda n: f"{-n} PRECEDING" if n < 0 else (f"{n} FOLLOWING" if n else "CURRENT ROW")
    return f"{value} OVER (PARTITION BY day ORDER BY seq ROWS BETWEEN {side(low)} AND {side(high)})"


@query(f"WITH {TICKS}, x AS (SELECT day, seq, {_frame('avg(price)', -5, 0)} AS past, {_frame('avg(price)', 5, 10)} AS future, {_frame('count(*)', -5, 0)} AS a, {_frame('count(*)', 5, 10)} AS b FROM ticks) SELECT day, seq, {r('(future - past) / past * 1e4', 'y')} FROM x WHERE a = 6 AND b = 6")
def q_smoothed_return_h10_k5(spark, d):
    return S.windowed(S.ticks(spark, d), {"y": L.smoothed_return(10, 5)}, before=5, after=10).where("y IS NOT NULL").select("day", "seq", "y")


@query(f"WITH {TICKS}, x AS (SELECT day, seq, price, {_frame('avg(price)', 1, 10)} AS future, {_frame('count(*)', 1, 10)} AS n FROM ticks) SELECT day, seq, {r('(future - price) / price * 1e4', 'y')} FROM x WHERE n = 10")
def q_mean_return_h10(spark, d):
    return S.windowed(S.ticks(spark, d), {"y": L.mean_return(10)}, after=10).where("y IS NOT NULL").select("day", "seq", "y")


@query(f"WITH {TICKS}, x AS (SELECT day, seq, price, {_frame('max(price)', 1, 10)} AS hi, {_frame('min(price)', 1, 10)} AS lo, {_frame('count(*)', 1, 10)} AS n FROM ticks) SELECT day, seq, {r('CASE WHEN abs((hi - price) / price * 1e4) >= abs((lo - price) / price * 1e4) THEN (hi - price) / price * 1e4 ELSE (lo - price) / price * 1e4 END', 'y')} FROM x WHERE n = 10")
def q_peak_return_h10(spark, d):
    return S.windowed(S.ticks(spark, d), {"y": L.peak_return(10)}, after=10).where("y IS NOT NULL").select("day", "seq", "y")


@query(f"WITH {TICKS}, s AS (SELECT *, ln(price / lag(price) OVER w) AS lr FROM ticks {W}), x AS (SELECT day, seq, {_frame('sum(lr * lr)', 1, 10)} AS v, {_frame('count(*)', 1, 10)} AS n FROM s) SELECT day, seq, {r('v', 'y')} FROM x WHERE n = 10")
def q_fwd_variance_h10(spark, d):
    return L.forward_variance(S.ticks(spark, d), 10, "y").where("y IS NOT NULL").select("day", "seq", "y")


@query(f"WITH {TICKS} SELECT day, seq, {r('(lead(price, 5) OVER w - price) / price * 1e4', 'y_5')}, {r('(lead(price, 10) OVER w - price) / price * 1e4', 'y_10')}, {r('(lead(price, 30) OVER w - price) / price * 1e4', 'y_30')} FROM ticks {W}")
def q_multi_horizon(spark, d):
    return S.windowed(S.ticks(spark, d), {f"y_{h}": L.point_return(h) for h in (5, 10, 30)}, after=30).select("day", "seq", "y_5", "y_10", "y_30")


@query(f"WITH {TICKS}, x AS (SELECT day, seq, lag(price, 2) OVER w AS a, lead(price, 3) OVER w AS b, lead(price, 10) OVER w AS e, price FROM ticks {W}) SELECT day, seq, {r('(b - price) / price * 1e4', 'y_3')}, {r('(e - price) / price * 1e4', 'y_10')} FROM x WHERE a IS NOT NULL AND e IS NOT NULL")
def q_forward_price_array(spark, d):
    rows = S.windowed(S.ticks(spark, d), {"fp": L.forward_prices(2, 10)}, before=2, after=10).where("fp IS NOT NULL")
    return rows.select("day", "seq", *[L.returns_from_forward(F.col("fp"), 2, h).alias(f"y_{h}") for h in (3, 10)])


@query(f"WITH {LABELED} SELECT day, CASE WHEN y > 8 THEN 1 WHEN y < -8 THEN -1 ELSE 0 END AS label, count(*) AS n FROM labeled WHERE y IS NOT NULL GROUP BY ALL")
def q_classify_bps(spark, d):
    return labeled(spark, d).where("y IS NOT NULL").groupBy("day", L.classify(F.col("y"), 8.0).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKS}, x AS (SELECT day, seq, {_frame('avg(price)', -9, 0)} AS past, {_frame('avg(price)', 1, 4)} AS future, {_frame('count(*)', 1, 4)} AS n FROM ticks) SELECT day, seq, CASE WHEN n < 4 OR past < 1e-8 THEN 0 WHEN (future - past) / past * 1e4 > 10 THEN 1 WHEN (future - past) / past * 1e4 < -10 THEN -1 ELSE 0 END AS label FROM x")
def q_profit_threshold_labels(spark, d):
    return S.windowed(S.ticks(spark, d), {"label": L.profit_labels(10, 20, 5, 10.0)}, before=9, after=4).select("day", "seq", "label")


@query(f"WITH {LABELED} SELECT day, seq, CAST(CASE WHEN y > 8 OR y < -8 THEN 1 ELSE 0 END AS BIGINT) AS signal FROM labeled WHERE y IS NOT NULL")
def q_binary_signal(spark, d):
    return labeled(spark, d).where("y IS NOT NULL").select("day", "seq", L.binary_signal(L.classify(F.col("y"), 8.0) + 1).alias("signal"))


@query("SELECT p_partkey AS id, p_partkey % 3 - 1 + CASE (p_partkey // 3) % 6 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS label FROM part")
def q_label_shift(spark, d):
    names = F.array(*[F.lit(x) for x in ("tlob", "opportunity", "trend", "triple_barrier", "regression", "unknown")])
    strategy = F.get(names, (F.floor(F.col("p_partkey") / 3) % 6).cast("int"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.shift_by_strategy(F.col("p_partkey") % 3 - 1, strategy).alias("label"))


@query(f"WITH {TICKS} SELECT day, seq, {r('(lead(price, 10) OVER w - price) / price * 1e4', 'primary_return')} FROM ticks {W}")
def q_horizon_map(spark, d):
    horizons = [5, 10, 30]
    rows = S.windowed(S.ticks(spark, d), {"labels": F.array(*[L.point_return(h) for h in horizons])}, after=30)
    return rows.select("day", "seq", F.element_at(L.label_map(horizons, F.col("labels")), F.lit(10)).alias("primary_return"))


def _weights(horizon: int, stride: int) -> str:
    return f"""WITH {TICKS}, spans AS (SELECT day, seq, seq * {stride} + unnest(range(0, {horizon})) AS t FROM ticks),
cover AS (SELECT day, t, count(*) AS c FROM spans GROUP BY day, t),
raw AS (SELECT s.day, s.seq, sum(1.0 / c) / {horizon} AS w FROM spans s JOIN cover USING (day, t) GROUP BY s.day, s.seq)
SELECT day, seq, {r('w / avg(w) OVER (PARTITION BY day)', 'weight')} FROM raw"""


@query(_weights(10, 1))
def q_sample_weights(spark, d):
    return L.sample_weights(S.ticks(spark, d), 10).select("day", "seq", "weight")


@query(_weights(10, 3))
def q_sample_weights_stride(spark, d):
    return L.sample_weights(S.ticks(spark, d), 10, 3).select("day", "seq", "weight")


@query(f"WITH {TICKS}, x AS (SELECT day, seq, {_frame('list(value)', -9, 0)} AS s FROM ticks) SELECT day, seq, {r('s[1]', 'first_value')}, {r('s[10]', 'last_value')} FROM x WHERE len(s) = 10 AND (seq - 9) % 5 = 0")
def q_sequences(spark, d):
    got = sequences(S.ticks(spark, d), F.array("value"), 10, 5)
    return got.select("day", "seq", F.get(F.get("sequence", F.lit(0)), F.lit(0)).alias("first_value"), F.get(S.last_step(), F.lit(0)).alias("last_value"))


# Day files --------------------------------------------------------------------------------------------------------


def day_export(spark, d):
    """Ticks as an export of day files (two steps of four features, forward prices, metadata); returns its path."""
    from ..sources.shared import shared_path

    features = F.array(F.col("value"), F.col("price"), F.col("k").cast("double"), F.col("seq").cast("double"))
    rows = S.windowed(S.ticks(spark, d), {"_f": features, "fp": L.forward_prices(2, 10)}, {"sequence": F.array(F.lag("_f").over(S.by_day()), F.col("_f"))}, before=2, after=10)
    rows = S.with_split(rows.where("fp IS NOT NULL")).select("split", "day", "seq", "sequence", "fp")
    path = shared_path(spark, "day-export")
    write_day_files(rows, path, {"sequences": "sequence", "forward_prices": "fp"})
    meta = F.to_json(F.struct(F.lit("2.2").alias("schema_version"), F.lit(4).alias("n_features"), F.lit([3, 10]).alias("horizons"), F.struct(F.lit(True).alias("exported"), F.lit(2).alias("smoothing_window_offset"), F.lit(13).alias("n_columns")).alias("forward_prices")))
    write_metadata(rows.select(F.col("split"), F.col("day").cast("string").alias("day")).distinct().withColumn("metadata", meta), path)
    return path


@query(f"""WITH {TICKS}, days AS (SELECT day, percent_rank() OVER (ORDER BY day) AS place FROM (SELECT day FROM ticks GROUP BY day HAVING count(*) > 12)),
x AS (SELECT day, seq, value, lag(value) OVER w AS before, lag(price, 2) OVER w AS a, lead(price, 3) OVER w AS b, lead(price, 10) OVER w AS e, price FROM ticks {W})
SELECT CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'val' ELSE 'test' END AS split, day, seq - 2 AS seq, {r('value', 'value')}, {r('before', 'before')},
{r('(b - price) / price * 1e4', 'y_3')}, {r('(e - price) / price * 1e4', 'y_10')}, CASE WHEN (e - price) / price * 1e4 > 8 THEN 1 WHEN (e - price) / price * 1e4 < -8 THEN -1 ELSE 0 END AS label, 'forward_prices' AS label_source
FROM x JOIN days USING (day) WHERE a IS NOT NULL AND e IS NOT NULL""")
def q_day_files(spark, d):
    path, loaded = day_export(spark, d), None
    for split in ("train", "val", "test"):
        one = load_split(spark, path, split, "2.2", threshold=8.0, columns=("features", "sequence"))
        loaded = one if loaded is None else loaded.unionByName(one)
    y = lambda i: F.get("regression_labels", F.lit(i))
    return loaded.select("split", "day", "seq", F.get("features", F.lit(0)).alias("value"), F.get(F.get("sequence", F.lit(0)), F.lit(0)).alias("before"), y(0).alias("y_3"), y(1).alias("y_10"), F.get("labels", F.lit(1)).alias("label"), "label_source")


@query(f"""WITH {TICKS}, n AS (SELECT day, count(*) - 12 AS n FROM ticks GROUP BY day HAVING count(*) > 12), p AS (SELECT *, percent_rank() OVER (ORDER BY day) AS place FROM n)
SELECT CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'val' ELSE 'test' END AS split, day, TRUE AS aligned, n AS n_rows, CAST(4 AS BIGINT) AS n_features, n AS forward_prices_rows FROM p""")
def q_day_headers(spark, d):
    return day_headers(spark, day_export(spark, d)).drop("labels_rows", "regression_labels_rows")
