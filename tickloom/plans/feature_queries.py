"""Queries over normalization, feature selection, rolling features and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import features as X
from ..operators import normalize as N
from ..operators.labels import point_return
from ..operators.resample import draw
from ..sources.ticks import numbered, price_and_spread, table, ticks, windowed
from .fixtures import SCORED, TICKS, VECTORS, W, query, r, scored, vectors

PRICES, SIZES = "(idx < 10 OR idx BETWEEN 20 AND 29)", "(idx BETWEEN 10 AND 19 OR idx BETWEEN 30 AND 39)"
KIND = f"CASE WHEN {PRICES} THEN 'price' WHEN {SIZES} THEN 'size' ELSE 'feature' END"
STATS = f"{r('avg(x)', 'mean')}, {r('greatest(stddev_pop(x), 1e-8)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')}, {r('quantile_cont(x, 0.5)', 'median')}, {r('quantile_cont(x, 0.25)', 'q25')}, {r('quantile_cont(x, 0.75)', 'q75')}, {r('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iqr')}, count(*) AS n"


@query(f"WITH {VECTORS} SELECT idx, {STATS} FROM cells GROUP BY idx")
def q_feature_stats(spark, d):
    return N.feature_statistics(vectors(spark, d), [])


@query(f"WITH {TICKS}, c AS (SELECT day, 0 AS idx, value AS x FROM ticks UNION ALL SELECT day, 1, CAST(k AS DOUBLE) FROM ticks) SELECT day, idx, {STATS} FROM c GROUP BY day, idx")
def q_feature_stats_per_day(spark, d):
    rows = ticks(spark, d).select("day", F.array("value", F.col("k").cast("double")).alias("features"))
    return N.feature_statistics(rows, ["day"])


@query(f"WITH {VECTORS} SELECT {KIND} AS kind, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, count(*) AS n FROM cells WHERE idx < 40 GROUP BY {KIND}")
def q_pooled_stats(spark, d):
    return N.pooled_stats(vectors(spark, d), N.layout("grouped"))


#: A row's vector is given back as the sum of its scaled parts weighted by place.
@query(f"WITH {VECTORS}, p AS (SELECT {KIND} AS kind, avg(x) AS m, stddev_pop(x) AS s FROM cells WHERE idx < 40 GROUP BY {KIND}) SELECT vec_id, {r('sum((idx + 1) * CASE WHEN p.kind IS NULL THEN x ELSE (x - m) / (s + 1e-8) END)', 'weighted')} FROM cells LEFT JOIN p ON p.kind = {KIND} GROUP BY vec_id")
def q_global_zscore(spark, d):
    v = vectors(spark, d)
    return N.apply_global(v, N.pooled_stats(v, N.layout("grouped")), N.layout("grouped")).select("vec_id", _weighted())


def _weighted():
    return F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).alias("weighted")


HYBRID = f"""{VECTORS},
g AS (SELECT *, CASE WHEN {PRICES} THEN -1 WHEN {SIZES} THEN -2 ELSE idx END AS g FROM cells),
st AS (SELECT g, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END AS s FROM g GROUP BY g)"""


@query(f"WITH {HYBRID} SELECT DISTINCT idx, {r('CASE WHEN idx = 50 THEN 0.0 ELSE m END', 'mean')}, {r('CASE WHEN idx = 50 THEN 1.0 ELSE s END', 'std')}, idx = 50 AS excluded FROM g JOIN st USING (g)")
def q_hybrid_stats(spark, d):
    return N.hybrid_stats(vectors(spark, d), N.layout("grouped"), (50,))


@query(f"WITH {HYBRID} SELECT vec_id, {r('sum((idx + 1) * CASE WHEN idx = 50 THEN x ELSE greatest(least((x - m) / s, 10), -10) END)', 'weighted')} FROM g JOIN st USING (g) GROUP BY vec_id")
def q_hybrid_normalize(spark, d):
    v = vectors(spark, d)
    return N.apply_hybrid(v, N.hybrid_stats(v, N.layout("grouped"), (50,))).select("vec_id", _weighted())


@query(f"SELECT l_orderkey, l_linenumber, {r('(l_quantity - (SELECT median(l_quantity) FROM lineitem)) / (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) FROM lineitem)', 'l_quantity')} FROM lineitem")
def q_robust_scale(spark, d):
    return N.scale_columns(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "robust")


@query(f"SELECT l_orderkey, l_linenumber, {r('(l_quantity - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem)', 'l_quantity')} FROM lineitem")
def q_minmax_scale(spark, d):
    return N.scale_columns(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], "minmax")


@query(f"WITH {TICKS} SELECT day, seq, {r('(value - avg(value) OVER (PARTITION BY day)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY day) < 1e-10 THEN 1.0 ELSE stddev_pop(value) OVER (PARTITION BY day) END', 'z')} FROM ticks")
def q_zscore_per_day(spark, d):
    return N.zscore_per_day(ticks(spark, d).select("day", "seq", "value"), "value", "z").drop("value")


@query(f"SELECT l_orderkey, l_linenumber, {r('(l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem)', 'z')} FROM lineitem")
def q_plain_zscore(spark, d):
    rows = table(spark, d, "lineitem")
    one = rows.agg(F.avg("l_tax").alias("m"), F.stddev_pop("l_tax").alias("s"))
    return rows.join(F.broadcast(one)).select("l_orderkey", "l_linenumber", N.plain_zscore(F.col("l_tax"), F.col("m"), F.col("s")).alias("z"))


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + f") SELECT feature, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'std')}, {r('min(x)', 'min')}, {r('max(x)', 'max')}, count(*) AS n FROM s GROUP BY feature")
def q_column_stats(spark, d):
    return N.column_statistics(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


PICK = [3, 40, 41, 63, 0]


@query(f"SELECT vec_id, {', '.join(r(f'CAST(embedding[{i + 1}] AS DOUBLE)', f'f_{k}') for k, i in enumerate(PICK))} FROM embeddings")
def q_feature_select(spark, d):
    got = vectors(spark, d).select("vec_id", X.select_features(F.col("features"), PICK, 64).alias("f"))
    return got.select("vec_id", *[F.get("f", F.lit(k)).alias(f"f_{k}") for k in range(len(PICK))])


@query(" UNION ALL ".join(f"SELECT vec_id, CAST({k} AS INTEGER) AS local, CAST({i} AS INTEGER) AS source, {r(f'CAST(embedding[{i + 1}] AS DOUBLE)', 'value')} FROM embeddings" for k, i in enumerate(PICK)))
def q_index_mapping(spark, d):
    """Every vector's selected values with their places before and after the selection."""
    got = vectors(spark, d).select("vec_id", F.posexplode(X.select_features(F.col("features"), PICK, 64)).alias("local", "value"))
    return got.join(F.broadcast(X.index_mapping(spark, PICK)), "local").select("vec_id", "local", "source", "value")


@query("SELECT count(*) AS n FROM embeddings WHERE list_bool_and([isfinite(x) FOR x IN embedding])")
def q_finite_rows(spark, d):
    return X.finite_rows(vectors(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT *, embedding[1] > 0 AS ok FROM embeddings) SELECT label, count(*) AS n FROM e WHERE ok OR label NOT IN (SELECT label FROM e WHERE ok) GROUP BY label")
def q_book_valid(spark, d):
    rows = vectors(spark, d).withColumn("features", F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    return X.book_valid(rows, 0, by="label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _last(e: str, w: int) -> str:
    return f"{e} OVER (PARTITION BY day ORDER BY seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _full(e: str, w: int) -> str:
    return f"CASE WHEN {_last('count(*)', w)} = {w} THEN {e} END"


@query(f"WITH {TICKS} SELECT day, seq, {', '.join(r(_full(_last('avg(value)', w), w), f'mean_{w}') for w in (5, 10, 20))} FROM ticks")
def q_rolling_mean_5_10_20(spark, d):
    return windowed(ticks(spark, d), {f"mean_{w}": X.rolling_mean("value", w) for w in (5, 10, 20)}, before=19).select("day", "seq", "mean_5", "mean_10", "mean_20")


@query(f"WITH {TICKS} SELECT day, seq, {r(_full(_last('regr_slope(value, seq)', 10), 10), 'slope_10')} FROM ticks")
def q_rolling_slope(spark, d):
    return windowed(ticks(spark, d), {"slope_10": X.rolling_slope("value", 10)}, before=9).select("day", "seq", "slope_10")


@query(f"WITH {TICKS} SELECT day, seq, {r('value - lag(value, 9) OVER w', 'roc_10')} FROM ticks {W}")
def q_roc(spark, d):
    return windowed(ticks(spark, d), {"roc_10": X.rate_of_change("value", 10)}, before=9).select("day", "seq", "roc_10")


@query(f"WITH {TICKS} SELECT day, seq, {r(_full(_last('stddev_pop(value)', 10), 10), 'std_10')} FROM ticks")
def q_rolling_std(spark, d):
    return windowed(ticks(spark, d), {"std_10": X.rolling_std("value", 10)}, before=9).select("day", "seq", "std_10")


LOGRET = TICKS + f", lr AS (SELECT *, ln(price) - ln(lag(price) OVER w) AS lr FROM ticks {W})"


def _vol(e: str, w: int) -> str:
    return f"CASE WHEN {_last('count(lr)', w)} = {w} THEN {e} END"


@query(f"WITH {LOGRET} SELECT day, seq, {r(_vol(_last('stddev_pop(lr)', 10) + ' * sqrt(10.0)', 10), 'vol_10')}, {r(_vol('sqrt(' + _last('sum(lr * lr)', 5) + ') * 1e4', 5), 'vol_bps_5')} FROM lr")
def q_realized_vol(spark, d):
    got = windowed(ticks(spark, d), {"logret": X.log_return()}, {"vol_10": X.realized_vol("logret", 10), "vol_bps_5": X.realized_vol_bps("logret", 5)}, before=10)
    return got.select("day", "seq", "vol_10", "vol_bps_5")


@query(f"WITH {TICKS} SELECT day, seq, {r(_full(_last('avg(value)', 5), 5) + ' - ' + _full(_last('avg(value)', 20), 20), 'momentum')} FROM ticks")
def q_momentum(spark, d):
    return windowed(ticks(spark, d), {"momentum": X.momentum("value")}, before=19).select("day", "seq", "momentum")


@query(f"WITH {TICKS} SELECT day, seq, {r('value * k', 'value_x_k')}, {r('value * price', 'value_x_price')}, {r('k * price', 'k_x_price')} FROM ticks")
def q_cross_products(spark, d):
    return ticks(spark, d).select("day", "seq", *X.cross_products(["value", "k", "price"]))


#: Features of the fixed layout, made of a tick's columns.
LAYOUT = {85: "value", 84: "CAST(k AS DOUBLE)", 86: "price", 56: "value - k", 45: "value + price", 42: "k * 0.5", 54: "2 * value", 40: "price", 95: "CAST(seq AS DOUBLE)", 93: "CAST(k % 7 AS DOUBLE)"}
_SET = X.order_book_set()
_TOP = _SET.signals[:3]
_TEMPORAL = ", ".join(
    [r(s, f"last_{s}") for s in _SET.signals]
    + [r(_full(_last(f"avg({s})", w), w), f"mean_{s}_{w}") for s in _TOP for w in (5, 10, 20)]
    + [r(_full(_last(f"regr_slope({s}, seq)", w), w), f"slope_{s}_{w}") for s in _TOP for w in (5, 10, 20)]
    + [r(f"{s} - lag({s}, {w - 1}) OVER w", f"change_{s}_{w}") for s in _TOP for w in (5, 10, 20)]
    + [r(f"{a} * {b}", f"product_{a}_{b}") for a, b in _SET.pairs]
    + [r(c, f"context_{c}") for c in _SET.context]
    + [r(c, f"regime_{c}") for c in _SET.regime]
    + [r(_full(_last(f"stddev_pop({s})", 10), 10), f"std_{s}_10") for s in _TOP]
    + [r(_vol(_last("stddev_pop(lr)", w) + f" * sqrt({w}.0)", w), f"volatility_{w}") for w in (10, 5)]
    + [r(_full(_last(f"avg({s})", 5), 5) + " - " + _full(_last(f"avg({s})", 20), 20), f"momentum_{s}") for s in _TOP]
)


@query(f"WITH {LOGRET}, t AS (SELECT day, seq, lr, {', '.join(f'{e} AS f{i}' for i, e in LAYOUT.items())} FROM lr) SELECT day, seq, {_TEMPORAL} FROM t {W}")
def q_temporal_features(spark, d):
    rows = ticks(spark, d).select("day", "seq", *[F.expr(e).cast("double").alias(f"f{i}") for i, e in LAYOUT.items()])
    return X.temporal_features(rows, _SET).drop(*[f"f{i}" for i in LAYOUT])


@query(f"WITH {VECTORS} SELECT vec_id, {', '.join(r(f'max(x) FILTER (WHERE idx = {i})', n) for i, n in ((40, 'price'), (42, 'spread')))} FROM cells GROUP BY vec_id")
def q_price_and_spread(spark, d):
    v = vectors(spark, d).withColumn("day", F.lit(0)).withColumnRenamed("vec_id", "seq")
    return price_and_spread(v, F.array("features")).select(F.col("seq").alias("vec_id"), "price", "spread")


#: Places of some feature sets below 64, written out.
_PRESETS = {
    "lob_only": "idx < 40",
    "lob_derived": "idx < 48",
    "deeplob_extended": "idx < 42 OR idx IN (45, 46)",
    "short_term_40": "idx IN (0, 1, 10, 11, 20, 21, 30, 31) OR idx BETWEEN 40 AND 46 OR idx BETWEEN 48 AND 59",
}


@query(f"WITH {VECTORS} " + " UNION ALL ".join(f"SELECT '{n}' AS preset, vec_id, count(*) AS n, {r('sum(x)', 'total')}, {r('max(x)', 'largest')} FROM cells WHERE {where} GROUP BY vec_id" for n, where in _PRESETS.items()))
def q_feature_presets(spark, d):
    """Vectors through each named feature set; what lies beyond their 64 values is null and not counted."""
    picked = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.filter(X.select_features(F.col("features"), list(X.PRESETS[n])), lambda x: x.isNotNull()).alias("f")) for n in _PRESETS]))
    got = vectors(spark, d).select("vec_id", picked.alias("p")).select("p.preset", "vec_id", "p.f")
    return got.select("preset", "vec_id", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("f").alias("largest"))


# Alignment --------------------------------------------------------------------------------------------------------

SOURCES = TICKS + """,
src AS (SELECT day, event_type, value, k, row_number() OVER (PARTITION BY day, event_type ORDER BY ts, event_id) - 1 AS seq FROM ticks),
a AS (SELECT * FROM src WHERE event_type = 'click'), b AS (SELECT * FROM src WHERE event_type = 'view')"""


def _source(spark, d, kind):
    from pyspark.sql import Window

    rows = ticks(spark, d).where(F.col("event_type") == kind)
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")) - 1).cast("long"))


@query(f"WITH {SOURCES} SELECT a.day, a.seq, {r('a.value', 'click_value')}, {r('b.value', 'view_value')} FROM a JOIN b ON a.day = b.day AND a.seq = b.seq")
def q_align_sources(spark, d):
    return A.align({"click": _source(spark, d, "click"), "view": _source(spark, d, "view")}, "click", ["value"])


@query(f"WITH {SOURCES} SELECT day FROM a INTERSECT SELECT day FROM b")
def q_common_days(spark, d):
    return A.common_days(_source(spark, d, "click"), _source(spark, d, "view"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT CAST(o_orderdate AS DATE)::VARCHAR FROM orders WHERE o_orderpriority = '5-LOW'")
def q_days_without(spark, d):
    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    return A.days_without(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '5-LOW'"))


@query(f"WITH {SOURCES} SELECT a.day, a.seq, {r('a.value + 2 * a.k + 3 * b.value + 4 * b.k', 'weighted')} FROM a JOIN b ON a.day = b.day AND a.seq = b.seq")
def q_fuse_features(spark, d):
    part = lambda kind: _source(spark, d, kind).withColumn("f", F.array("value", F.col("k").cast("double")))
    got = A.fuse(A.align({"view": part("view"), "click": part("click")}, "click", ["f"]), ["click_f", "view_f"])
    return got.select("day", "seq", _weighted())


@query(f"WITH {SOURCES}, x AS (SELECT day, count(*) AS n FROM a GROUP BY day), y AS (SELECT day, count(*) AS n FROM b GROUP BY day) SELECT coalesce(x.day, y.day) AS day, coalesce(x.n, 0) AS n_left, coalesce(y.n, 0) AS n_right, least(coalesce(x.n, 0), coalesce(y.n, 0)) AS n_both FROM x FULL JOIN y ON x.day = y.day")
def q_alignment_counts(spark, d):
    return A.alignment_counts(_source(spark, d, "click"), _source(spark, d, "view"))


@query(f"WITH {SCORED}, x AS (SELECT y, CASE WHEN k = 7 THEN NULL ELSE yhat END AS p FROM scored) SELECT count(*) AS n, {r('avg(y - p)', 'mean_error')} FROM x WHERE p IS NOT NULL")
def q_paired_drop_nonfinite(spark, d):
    rows = scored(spark, d).withColumn("p", F.when(F.col("k") == 7, float("nan")).otherwise(F.col("yhat")))
    kept, _ = A.drop_nonfinite(rows, ["y", "p"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("p")).alias("mean_error"))


@query(f"WITH {SCORED}, t AS (SELECT day, seq, y, yhat AS a, 0.5 * yhat AS b, 0.0 AS c FROM scored) SELECT {r('avg(abs(y - a))', 'mae_a')}, {r('avg(abs(y - b))', 'mae_b')}, {r('avg(abs(y - c))', 'mae_c')}, count(*) AS n FROM t")
def q_paired_treatments(spark, d):
    s = scored(spark, d)
    parts = {"a": s, "b": s.withColumn("yhat", 0.5 * F.col("yhat")), "c": s.withColumn("yhat", F.lit(0.0))}
    got = A.paired(parts)
    return got.agg(*[F.avg(F.abs(F.col("y") - F.col(n))).alias(f"mae_{n}") for n in "abc"], F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKS} SELECT day, seq, {r('(lead(price, 30) OVER w - price) / price * 1e4', 'y')} FROM ticks {W} QUALIFY lead(price, 30) OVER w IS NOT NULL")
def q_forward_lookup(spark, d):
    return windowed(ticks(spark, d), {"y": point_return(30)}, after=30).where("y IS NOT NULL").select("day", "seq", "y")


@query(f"WITH {TICKS}, b AS (SELECT day, sum(count(*)) OVER (ORDER BY day) - count(*) AS first, sum(count(*)) OVER (ORDER BY day) - 1 AS last FROM ticks GROUP BY day), i AS (SELECT p_partkey AS index FROM part) SELECT index, day FROM i JOIN b ON index BETWEEN first AND last")
def q_day_of_index(spark, d):
    from pyspark.sql import Window

    counts = ticks(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("day"))
    bounds = counts.select("day", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))
    return A.day_of(table(spark, d, "part").select(F.col("p_partkey").alias("index")), bounds)


_DRAW = lambda x: f"(({x}) * 48271 + 12345) % 2147483647"


@query(f"WITH {TICKS}, i AS (SELECT day, seq, value, row_number() OVER (ORDER BY day, seq) - 1 AS i FROM ticks) SELECT day, seq, {r('value', 'value')} FROM i ORDER BY ({_DRAW(_DRAW(_DRAW('(i * 104729 + 42) % 2147483647')))}) % 2147483646, i LIMIT 500")
def q_subsample(spark, d):
    rows = numbered(ticks(spark, d).select("day", "seq", "value"))
    return A.subsample(rows, 500, 42, ["day", "seq"], draw(F.lit(0), F.col("i"), 42, F.lit(2147483646).cast("long"))).drop("i")


_STEPS = f"""steps AS (SELECT vec_id, idx, x, 0 AS step FROM c UNION ALL SELECT vec_id, idx, -2 * x, 1 FROM c),
g AS (SELECT *, CASE WHEN {PRICES} THEN -1 WHEN {SIZES} THEN -2 ELSE idx END AS g FROM steps),
st AS (SELECT g, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END AS s FROM g GROUP BY g)"""


@query(f"WITH {VECTORS}, c AS (SELECT * FROM cells), {_STEPS} SELECT vec_id, step, {r('sum((idx + 1) * CASE WHEN idx = 50 THEN x ELSE greatest(least((x - m) / s, 10), -10) END)', 'weighted')} FROM g JOIN st USING (g) GROUP BY vec_id, step")
def q_sequence_normalize(spark, d):
    """Sequences of two steps, scaled by statistics over the steps of all of them."""
    v = vectors(spark, d).select("vec_id", F.array(F.col("features"), F.transform("features", lambda x: -2 * x)).alias("sequence"))
    scaled = N.apply_hybrid(v, N.hybrid_stats(v, N.layout("grouped"), (50,), "sequence"), "sequence")
    return scaled.select("vec_id", F.posexplode("sequence").alias("step", "features")).select("vec_id", "step", _weighted())
