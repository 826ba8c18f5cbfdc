"""Queries over classification, regression and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classification as C
from ..operators import regression as R
from ..sources.ticks import by_day, table, ticks, windowed
from .fixtures import SCORED, TICKS, W, labeled, query, r, ratio_sql, scored


@query(f"WITH {SCORED} SELECT a.i AS label, b.i AS pred, count(s.day) AS n FROM range(3) a(i) CROSS JOIN range(3) b(i) LEFT JOIN scored s ON s.label = a.i AND s.pred = b.i GROUP BY a.i, b.i")
def q_confusion_matrix(spark, d):
    return C.confusion_matrix(scored(spark, d), 3)


REPORT = f"""report AS (
  SELECT c.i AS label, count(*) FILTER (WHERE s.label = c.i AND s.pred = c.i) AS tp, count(*) FILTER (WHERE s.label = c.i) AS support, count(*) FILTER (WHERE s.pred = c.i) AS predicted
  FROM range(3) c(i), scored s GROUP BY c.i),
rates AS (SELECT *, {ratio_sql('tp', 'predicted')} AS precision, {ratio_sql('tp', 'support')} AS recall FROM report),
f AS (SELECT *, {ratio_sql('2 * precision * recall', 'precision + recall')} AS f1 FROM rates)"""


@query(f"WITH {SCORED}, {REPORT} SELECT label, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, support, predicted FROM f")
def q_class_report(spark, d):
    return C.class_report(scored(spark, d), 3)


@query(f"WITH {SCORED}, {REPORT} SELECT (SELECT {r('avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)', 'x')} FROM scored) AS accuracy, (SELECT count(*) FROM scored) AS n, {r('avg(precision)', 'macro_precision')}, {r('avg(recall)', 'macro_recall')}, {r('avg(f1)', 'macro_f1')} FROM f")
def q_macro_metrics(spark, d):
    return C.macro_metrics(scored(spark, d), 3)


OUT_P, OUT_L = "pred IN (0, 2)", "label IN (0, 2)"


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


def _part(a: str, b: str) -> str:
    return ratio_sql(f"count(*) FILTER (WHERE {a})", f"count(*) FILTER (WHERE {b})")


@query(f"WITH {SCORED} SELECT {r(_share(OUT_P), 'signal_rate')}, {r(_share(OUT_L), 'true_signal_rate')}, {r(_share(OUT_P), 'decisive_prediction_rate')}, {r(_share(OUT_L), 'true_decisive_rate')}, {r(_part('label = 2', OUT_L), 'true_win_rate')}, {r(_part('label = 2 AND ' + OUT_P, OUT_P), 'predicted_trade_win_rate')} FROM scored")
def q_triple_barrier_metrics(spark, d):
    return C.triple_barrier_metrics(scored(spark, d))


@query(f"WITH {SCORED} SELECT {r(_share(OUT_P), 'signal_rate')}, {r(_share(OUT_L), 'true_signal_rate')}, {r(_share(OUT_P), 'opportunity_prediction_rate')}, {r(_share(OUT_L), 'true_opportunity_rate')}, {r(_part(OUT_P + ' AND label = pred', OUT_P), 'directional_accuracy')} FROM scored")
def q_opportunity_metrics(spark, d):
    return C.opportunity_metrics(scored(spark, d))


@query(f"WITH {SCORED} SELECT {r(_share(OUT_P), 'signal_rate')}, {r(_share(OUT_L), 'true_signal_rate')}, {r(_part(OUT_P + ' AND label = pred', OUT_P), 'directional_accuracy')} FROM scored")
def q_tlob_metrics(spark, d):
    return C.tlob_metrics(scored(spark, d))


@query(f"WITH {SCORED} SELECT {r(_share(OUT_P), 'signal_rate')}, {r(_part(OUT_P + ' AND label = pred', OUT_P), 'directional_accuracy')}, {r(_part('pred = 2 AND label = 2', 'pred = 2'), 'up_precision')}, {r(_part('pred = 0 AND label = 0', 'pred = 0'), 'down_precision')} FROM scored")
def q_trading_metrics(spark, d):
    return C.trading_metrics(scored(spark, d))


@query(f"WITH {SCORED}, c AS (SELECT *, label <> lag(label) OVER w AS changed FROM scored {W}) SELECT {r('coalesce(' + _share('label = pred') + ', 0.0)', 'transition_accuracy')}, count(*) AS n_transitions FROM c WHERE changed")
def q_transition_accuracy(spark, d):
    return C.transition_accuracy(scored(spark, d))


@query(f"WITH {SCORED}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY label), w AS (SELECT label, n, (sum(n) OVER ()) / (3.0 * greatest(n, 1)) AS weight FROM c) SELECT label, n, {r('weight', 'weight')}, {r('weight / sum(weight) OVER () * 3', 'focal_weight')} FROM w")
def q_class_weights(spark, d):
    return C.class_weights(scored(spark, d), 3)


@query(f"WITH {SCORED} SELECT label, CASE label WHEN 0 THEN 'StopLoss' WHEN 1 THEN 'Timeout' ELSE 'ProfitTarget' END AS name, count(*) AS n FROM scored GROUP BY label")
def q_class_names(spark, d):
    return scored(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("name", C.name_class(F.col("label"), "triple_barrier", 3))


@query(f"WITH {SCORED} SELECT count(*) AS n, {r('avg(y)', 'mean_return')} FROM scored WHERE agreement >= 1.0 AND confirmation > 0.65 AND spread <= 1.05 AND pred IN (0, 2)")
def q_readability_gate(spark, d):
    return scored(spark, d).where(C.readable()).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_return"))


CONFIDENCE = {
    "all_samples": "TRUE", "agreement=1.0": "agreement = 1", "agreement>=0.667": "agreement >= 0.667", "agreement<1.0": "agreement < 1",
    **{f"confirm>{c}": f"confirmation > {c}" for c in ("0.50", "0.55", "0.60", "0.65", "0.70", "0.75")},
    **{f"agree=1.0 AND confirm>{c}": f"agreement = 1 AND confirmation > {c}" for c in ("0.60", "0.65", "0.70", "0.75")},
    "directional AND agree=1.0": f"agreement = 1 AND {OUT_P}", "directional AND agree=1.0 AND confirm>0.70": f"agreement = 1 AND confirmation > 0.70 AND {OUT_P}",
}
ONE, TWO, WIDE, FULL, SURE = "spread <= 1.05", "spread > 1.05 AND spread <= 2.05", "spread > 2.05", "agreement = 1", "agreement = 1 AND confirmation > 0.65"
SPREAD = {
    "all_samples": "TRUE", "spread=1tick": ONE, "spread=2tick": TWO, "spread=wide": WIDE, "agree=1.0": FULL, "agree=1.0 + spread=1tick": f"{FULL} AND {ONE}",
    "agree=1.0 + spread=2tick": f"{FULL} AND {TWO}", "high_conf": SURE, "high_conf + spread=1tick": f"{SURE} AND {ONE}", "high_conf + spread=2tick": f"{SURE} AND {TWO}",
    "FULL_READABILITY: high_conf+1tick+dir": f"{SURE} AND {ONE} AND {OUT_P}", "disagree (<1.0)": "agreement <> 1", "disagree + spread=1tick": f"agreement <> 1 AND {ONE}",
}


def conditioned(filters: dict[str, str], more: str = "") -> str:
    both = f"{OUT_P} AND {OUT_L}"
    classes = ", ".join(f"{r(_part(f'label = {c} AND pred = {c}', f'pred = {c}'), f'precision_{c}')}, {r(_part(f'label = {c} AND pred = {c}', f'label = {c}'), f'recall_{c}')}, count(*) FILTER (WHERE label = {c}) AS support_{c}, count(*) FILTER (WHERE pred = {c}) AS predicted_{c}" for c in range(3))
    one = lambda name, c: f"""SELECT '{name}' AS filter, count(*) AS n, {r(ratio_sql('count(*)', '(SELECT count(*) FROM later)'), 'rate')}, {r('coalesce(' + _share('label = pred') + ', 0.0)', 'accuracy')}, {r(_part(both + ' AND label = pred', both), 'directional_accuracy')}, count(*) FILTER (WHERE {both}) AS n_directional, {classes}{more} FROM later WHERE {c}"""
    return f"WITH {SCORED}, later AS (SELECT *, coalesce(lead(label, 5) OVER w, -1) AS l5 FROM scored {W}) " + " UNION ALL ".join(one(n, c) for n, c in filters.items())


@query(conditioned(CONFIDENCE, "".join(f", {r('coalesce(' + _share(f'{x} = pred') + ', 0.0)', f'h{h}_accuracy')}" for h, x in ((10, "label"), (15, "l5")))))
def q_conditioned_metrics(spark, d):
    return C.conditioned_metrics(_later(spark, d), C.confidence_filters(), {10: ("label", "pred"), 15: ("l5", "pred")})


def _later(spark, d):
    return windowed(scored(spark, d), {"l5": F.coalesce(F.lead("label", 5).over(by_day()), F.lit(-1))}, after=5)


@query(conditioned(SPREAD))
def q_spread_buckets(spark, d):
    return C.conditioned_metrics(scored(spark, d), C.spread_filters())


@query(f"WITH {SCORED} SELECT count(spread) AS n, {', '.join(r(f'quantile_cont(CAST(spread AS DOUBLE), {p / 100})', f'p{p}') for p in (10, 25, 50, 75, 90, 95, 99))}, {', '.join(f'count(*) FILTER (WHERE {c}) AS n_{n}, {r(_share(c), f'share_{n}')}' for n, c in (('1tick', ONE), ('2tick', TWO), ('wide', WIDE)))} FROM scored")
def q_spread_distribution(spark, d):
    return C.spread_distribution(scored(spark, d))


@query(f"WITH {SCORED} SELECT day, {r('sum(spread * k) / sum(k)', 'mean_spread')}, CAST(sum(k) AS BIGINT) AS n FROM scored GROUP BY day HAVING sum(k) > 0")
def q_weighted_epochs(spark, d):
    return C.weighted_epochs(scored(spark, d), "day", "spread", "k").where("n > 0")


@query(f"WITH {SCORED} SELECT count(*) FILTER (WHERE pred = 0) AS n_pred_0, count(*) FILTER (WHERE pred = 1) AS n_pred_1, count(*) FILTER (WHERE pred = 2) AS n_pred_2, {r(_share('pred <> 1'), 'directional_rate')}, count(*) FILTER (WHERE agreement > 0.99) AS n_full_agreement, {r('avg(agreement)', 'mean_agreement')}, {r('avg(confirmation)', 'mean_confirmation')}, {', '.join(r(f'quantile_cont(CAST(confirmation AS DOUBLE), {p / 100})', f'confirmation_p{p}') for p in (25, 50, 75, 99))} FROM scored")
def q_prediction_distribution(spark, d):
    return C.prediction_distribution(scored(spark, d))


@query(f"WITH {SCORED}, m AS (SELECT label, pred, coalesce(lead(label, 5) OVER w, -1) AS l5 FROM scored {W}) SELECT 10 AS horizon, {r(_share('label = pred'), 'accuracy')}, count(*) AS n FROM m UNION ALL SELECT 15, {r(_share('l5 = pred'), 'accuracy')}, count(*) FROM m")
def q_horizon_accuracy(spark, d):
    rows = _later(spark, d).select(F.col("label").alias("label_h10"), F.col("pred").alias("pred_h10"), F.col("l5").alias("label_h15"), F.col("pred").alias("pred_h15"))
    return C.horizon_accuracy(rows, [10, 15])


# Regression -------------------------------------------------------------------------------------------------------


def pearson_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-14 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def ranks(x: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{x}) - 1) / 2.0"


MOMENTS = f"""{r('CASE WHEN var_pop(y) * count(*) > 1e-12 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) ELSE 0.0 END', 'r2')},
{r(pearson_sql('y', 'yhat'), 'pearson')}, {r('avg(abs(y - yhat))', 'mae')}, {r('sqrt(avg((y - yhat) * (y - yhat)))', 'rmse')},
{r(ratio_sql('count(*) FILTER (WHERE y <> 0 AND sign(y) = sign(yhat))', 'count(*) FILTER (WHERE y <> 0)', '0.5'), 'directional_accuracy')},
{r(ratio_sql('count(*) FILTER (WHERE abs(y) > 5 AND sign(y) = sign(yhat))', 'count(*) FILTER (WHERE abs(y) > 5)'), 'profitable_accuracy')}"""


@query(f"WITH {SCORED}, k AS (SELECT *, {ranks('y')} AS ry, {ranks('yhat')} AS rp FROM scored) SELECT {MOMENTS}, {r(pearson_sql('ry', 'rp'), 'ic')}, count(*) AS n FROM k")
def q_regression_metrics(spark, d):
    return R.regression_metrics(scored(spark, d), [])


@query(f"WITH {SCORED}, k AS (SELECT *, {ranks('y', 'event_type')} AS ry, {ranks('value', 'event_type')} AS rv FROM scored) SELECT event_type, {r(pearson_sql('ry', 'rv'), 'ic')}, count(*) AS n FROM k GROUP BY event_type")
def q_spearman_ic(spark, d):
    return R.spearman(scored(spark, d), "y", "value", ["event_type"])


@query(f"WITH {SCORED}, w AS (SELECT day, seq, yhat, {', '.join(f'(lead(price, {h}) OVER w - price) / price * 1e4 AS y{h}' for h in (1, 5, 10))} FROM scored {W}), h AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, y{h} AS y, yhat FROM w WHERE y{h} IS NOT NULL' for h in (1, 5, 10))}), k AS (SELECT *, {ranks('y', 'horizon')} AS ry, {ranks('yhat', 'horizon')} AS rp FROM h) SELECT horizon, {MOMENTS}, {r(pearson_sql('ry', 'rp'), 'ic')}, count(*) AS n FROM k GROUP BY horizon")
def q_directional_by_horizon(spark, d):
    return R.regression_metrics(R.by_horizon(scored(spark, d), [1, 5, 10]), ["horizon"])


@query(f"WITH {SCORED}, h AS (SELECT day, seq, CASE WHEN sign(y) = sign(yhat) THEN 1.0 ELSE 0.0 END AS hit FROM scored WHERE y <> 0), c AS (SELECT *, lag(hit) OVER w AS before, (SELECT avg(hit) FROM h) AS m FROM h {W}) SELECT {r('avg(hit)', 'da')}, count(*) AS n, {r(ratio_sql('sum((hit - m) * (before - m))', 'sum((hit - m) * (hit - m))'), 'hit_autocorrelation')} FROM c")
def q_hit_autocorr(spark, d):
    return R.hit_tripwire(scored(spark, d))


NUMBERS = ["l_quantity", "l_extendedprice", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


def stacked(columns: list[str], label: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST({label} AS DOUBLE) AS y FROM lineitem" for c in columns)


CORRELATED = f"""s AS ({stacked(NUMBERS, 'l_discount')}),
c AS (SELECT feature, CASE WHEN stddev_pop(x) < 1e-10 THEN 0.0 ELSE coalesce({pearson_sql('x', 'y')}, 0.0) END AS r, count(*) AS n FROM s GROUP BY feature)"""


@query(f"WITH {CORRELATED} SELECT feature, {r('r', 'r')}, n, CASE WHEN r > 0.01 THEN '+' WHEN r < -0.01 THEN '-' ELSE '0' END AS direction FROM c")
def q_feature_correlation(spark, d):
    return R.feature_correlations(table(spark, d, "lineitem"), NUMBERS, "l_discount")


SCREENED = f"""s AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM lineitem" for h, y in ((10, 'l_discount'), (20, 'l_tax')) for c in NUMBERS if c != 'l_tax')}),
c AS (SELECT horizon, feature, CASE WHEN stddev_pop(x) < 1e-10 THEN 0.0 ELSE coalesce({pearson_sql('x', 'y')}, 0.0) END AS r, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT *, CASE WHEN r > 0.01 THEN '+' WHEN r < -0.01 THEN '-' ELSE '0' END AS direction FROM c)"""


@query(f"WITH {SCREENED} SELECT horizon, feature, {r('r', 'r')}, n, direction, row_number() OVER (PARTITION BY horizon ORDER BY abs(r) DESC, feature) AS rank, CASE WHEN direction <> '0' THEN row_number() OVER (PARTITION BY horizon, direction ORDER BY abs(r) DESC, feature) END AS place, row_number() OVER (PARTITION BY feature ORDER BY abs(r) DESC, horizon) = 1 AS best FROM g")
def q_feature_screening(spark, d):
    got = R.screening(table(spark, d, "lineitem"), [c for c in NUMBERS if c != "l_tax"], {10: "l_discount", 20: "l_tax"}).drop("p")
    return got.withColumn("rank", F.col("rank").cast("long")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {CORRELATED} SELECT feature, {r('r', 'r')}, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM c QUALIFY rank <= 3")
def q_topk_features(spark, d):
    from ..operators.evaluate import top_features

    return top_features(R.feature_correlations(table(spark, d, "lineitem"), NUMBERS, "l_discount"), 3, "r").select("feature", "r", F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS ({stacked(NUMBERS, 'l_discount')}), k AS (SELECT feature, {ranks('x', 'feature')} AS rx, {ranks('y', 'feature')} AS ry FROM s), c AS (SELECT feature, coalesce({pearson_sql('rx', 'ry')}, 0.0) AS ic, count(*) AS n FROM k GROUP BY feature) SELECT feature, {r('ic', 'ic')}, n, abs(ic) > 0.05 AS passes, (sum(CASE WHEN abs(ic) > 0.05 THEN 1 ELSE 0 END) OVER ()) >= 3 AS gate_passed FROM c")
def q_ic_gate(spark, d):
    return R.ic_gate(table(spark, d, "lineitem"), NUMBERS, "l_discount")


@query(f"SELECT {r('avg(l_extendedprice)', 'mean')}, {r('stddev_pop(l_extendedprice)', 'std')}, {r('min(l_extendedprice)', 'min')}, {r('max(l_extendedprice)', 'max')}, {r('quantile_cont(l_extendedprice, 0.5)', 'median')}, {r('quantile_cont(l_extendedprice, 0.9)', 'p90')} FROM lineitem")
def q_distribution(spark, d):
    return R.distribution(table(spark, d, "lineitem"), "l_extendedprice")


LEVELS = (0, 1, 2, 2.15, 3, 5, 10)
MOVES = SCORED + f""",
wide AS (SELECT price, pred, agreement, confirmation, spread, {', '.join(f'(lead(price, {h}) OVER w - price) / price * 1e4 AS m{h}' for h in range(1, 31))} FROM scored {W}),
moves AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, price, m{h} AS raw, CASE WHEN pred = 2 THEN m{h} ELSE -m{h} END AS move FROM wide WHERE m{h} IS NOT NULL AND agreement >= 1.0 AND confirmation > 0.65 AND spread <= 1.05 AND pred IN (0, 2)' for h in range(1, 31))})"""
DOLLAR = "(0.5 * avg(price) / 1e4 * 100)"


@query(f"WITH {MOVES} SELECT horizon, count(*) AS n, {r('avg(move)', 'mean')}, {r('stddev_pop(move)', 'std')}, {r('min(move)', 'min')}, {r('max(move)', 'max')}, {r('avg(raw)', 'raw_mean')}, {r('stddev_pop(raw)', 'raw_std')}, {r('avg(abs(raw))', 'raw_abs_mean')}, {r('quantile_cont(abs(raw), 0.5)', 'raw_abs_median')}, {', '.join(r(_share(f'move > {x}'), 'share_over_' + str(x).replace('.', '_')) for x in LEVELS)}, {', '.join(r(f'quantile_cont(move, {x / 100})', f'p{x}') for x in (10, 25, 50, 75, 90))}, {r('avg(price)', 'entry_price')}, {r('1.40 / ' + DOLLAR, 'breakeven')}, {r('avg(move) * ' + DOLLAR, 'gross')}, {r('avg(move) * ' + DOLLAR + ' - 1.40', 'net')} FROM moves GROUP BY horizon")
def q_move_magnitude(spark, d):
    return R.move_magnitudes(scored(spark, d), list(range(1, 31)), C.readable())


@query(f"WITH {MOVES} SELECT min(horizon) AS first_profitable_horizon FROM (SELECT horizon FROM moves GROUP BY horizon HAVING avg(move) * {DOLLAR} - 1.40 > 0)")
def q_first_profitable(spark, d):
    return R.first_profitable(R.move_magnitudes(scored(spark, d), list(range(1, 31)), C.readable()))


@query(f"WITH {TICKS}, f AS (SELECT event_type, day, avg(value) AS value FROM ticks GROUP BY ALL) SELECT event_type, {r('avg(value)', 'value_mean')}, {r('coalesce(stddev_samp(value), 0.0)', 'value_std')}, count(*) AS n_folds FROM f GROUP BY event_type")
def q_fold_metrics(spark, d):
    return R.fold_summary(ticks(spark, d).groupBy("event_type", "day").agg(F.avg("value").alias("value")), ["event_type"], "value")


@query(f"WITH {SCORED}, p AS (SELECT day, max(y) AS hi, min(y) AS lo FROM scored GROUP BY day) SELECT day, {r('hi', 'hi')}, {r('lo', 'lo')} FROM p")
def q_day_extremes(spark, d):
    return labeled(spark, d).where("y IS NOT NULL").groupBy("day").agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
