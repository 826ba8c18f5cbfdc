"""Queries over calibration, baselines, the registry, resampling, models, monitoring and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import monitor as O
from ..operators import resample as B
from ..operators import validate as V
from ..operators.audit import write_audited
from ..sources.shared import materialize, shared_path
from ..sources.ticks import numbered, table, ticks, with_split
from .fixtures import EPOCHS, EXPERIMENTS, SCORED, TICKS, W, epochs, experiments, query, r, scored
from .metric_queries import pearson_sql, ranks


@query(f"WITH {SCORED}, s AS (SELECT avg(yhat) AS pm, stddev_pop(yhat) AS ps, avg(y) AS tm, stddev_pop(y) AS ts FROM scored) SELECT day, seq, {r('(yhat - pm) * (s.ts / ps) + tm', 'calibrated')} FROM scored, s")
def q_calibrate_variance(spark, d):
    return E.calibrate_variance(scored(spark, d)).select("day", "seq", "calibrated")


BASELINES = SCORED + f", p AS (SELECT *, coalesce(lag(label) OVER w, label) AS prev FROM scored {W}), c AS (SELECT max(n) / sum(n) AS prior FROM (SELECT count(*) AS n FROM scored GROUP BY label)), m AS (SELECT avg(CASE WHEN label = CASE WHEN yhat > 0 THEN 2 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS model, avg(CASE WHEN prev = label THEN 1.0 ELSE 0.0 END) AS prev FROM p)"


@query(f"WITH {BASELINES} SELECT {r('model', 'model')}, {r('prior', 'class_prior')}, {r('prev', 'previous_label')}, {r('(model - prior) * 100', 'over_prior_pp')}, {r('(model - prev) * 100', 'over_previous_pp')} FROM m, c")
def q_baseline_report(spark, d):
    return E.baseline_report(scored(spark, d).withColumn("pred", F.when(F.col("yhat") > 0, 2).otherwise(0)))


@query(f"WITH {SCORED}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY label) SELECT label AS majority, n, {r('n / (SELECT sum(n) FROM c)', 'share')} FROM c ORDER BY n DESC, label LIMIT 1")
def q_class_prior(spark, d):
    return E.class_prior(scored(spark, d))


@query(f"WITH {SCORED} SELECT 'previous' AS name, {r('avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(*) AS n FROM scored UNION ALL SELECT 'contrarian', {r('avg(CASE WHEN label = CASE WHEN yhat > 0 THEN 2 ELSE 0 END THEN 1.0 ELSE 0.0 END)', 'accuracy')}, count(*) FROM scored")
def q_baseline_sweep(spark, d):
    return E.sweep(scored(spark, d).withColumn("contrarian", F.when(F.col("yhat") > 0, 2).otherwise(0)), {"previous": "pred", "contrarian": "contrarian"})


@query(f"WITH {SCORED}, m AS (SELECT day, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(y) AS edge FROM scored GROUP BY day) SELECT day, {r('accuracy', 'accuracy')}, {r('edge', 'edge')}, accuracy >= 0.5 AS passed_accuracy, edge >= 0.0 AS passed_edge, accuracy >= 0.5 AND edge >= 0.0 AS passed FROM m")
def q_decision_gates(spark, d):
    per_day = scored(spark, d).groupBy("day").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.avg("y").alias("edge"))
    return E.gates(per_day, {"accuracy": 0.5, "edge": 0.0})


@query(f"WITH {EXPERIMENTS} SELECT id, name, {r('accuracy', 'accuracy')} FROM experiments ORDER BY coalesce(accuracy, 0) DESC, id LIMIT 20")
def q_rank_models(spark, d):
    return E.rank_experiments(experiments(spark, d), "accuracy", top=20).select("id", "name", "accuracy")


@query(f"WITH {EXPERIMENTS} SELECT id FROM experiments WHERE strategy = 'ECONOMY' AND list_has_any(tags, ['red', 'bolt']) AND accuracy >= 0.4")
def q_registry_filter(spark, d):
    return E.filter_experiments(experiments(spark, d), strategy="ECONOMY", tags=["red", "bolt"], least={"accuracy": 0.4}).select("id")


@query(f"WITH {EXPERIMENTS} SELECT 'model' AS kind, model AS name, count(*) AS n FROM experiments GROUP BY model UNION ALL SELECT 'strategy', strategy, count(*) FROM experiments GROUP BY strategy")
def q_registry_summary(spark, d):
    return E.registry_summary(experiments(spark, d))


@query(f"WITH {EXPERIMENTS} SELECT rpad(left(name, 25), 25, ' ') || ' | ' || lpad(printf('%.4f', accuracy), 12, ' ') || ' | ' || lpad(printf('%.4f', f1), 12, ' ') AS line FROM experiments")
def q_comparison_table(spark, d):
    return E.comparison_table(experiments(spark, d), ["accuracy", "f1"], sort_by="f1")


@query(f"WITH {EXPERIMENTS} SELECT id, CASE WHEN accuracy > f1 + 0.01 THEN 'bullish' WHEN f1 > accuracy + 0.01 THEN 'bearish' ELSE 'neutral' END AS direction FROM experiments")
def q_coefficient_direction(spark, d):
    return experiments(spark, d).select("id", E.coefficient_direction(F.col("accuracy"), F.col("f1")).alias("direction"))


@query("""SELECT p_partkey AS id, p_name || '_20240101T000000_' || left(sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 8) AS experiment_id FROM part""")
def q_experiment_id(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), E.experiment_id(F.col("p_name"), F.lit("20240101T000000"), F.col("p_brand"), F.col("p_size")).alias("experiment_id"))


@query(f"WITH {SCORED}, m AS (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM scored) SELECT 'test_accuracy' AS metric, {r('accuracy', 'value')} FROM m UNION ALL SELECT 'test_n', {r('CAST(n AS DOUBLE)', 'value')} FROM m")
def q_flat_metrics(spark, d):
    return E.flatten_metrics(scored(spark, d).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


_DISTRIBUTIONS = [(f"{c}_{n}", f"{f}({c})") for c in ("yhat", "y", "price", "spread") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]


@query(f"WITH {SCORED} SELECT 'contrarian' AS model_type, 'experiment' AS experiment_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day, {', '.join(r(e, n) for n, e in _DISTRIBUTIONS)}, TRUE AS fingerprint_fits FROM scored")
def q_signal_metadata(spark, d):
    """The record as read back from its JSON; the fingerprint is that of the rest."""
    kinds = "model_type string, experiment_id string, n long, first_day string, last_day string, " + ", ".join(f"{n} double" for n, _ in _DISTRIBUTIONS)
    got = E.signal_metadata(scored(spark, d), "contrarian", "experiment").select(F.from_json("json", f"{kinds}, fingerprint string").alias("m"), "json")
    body = F.concat(F.regexp_extract("json", r'^(.*),"fingerprint":', 1), F.lit("}"))
    return got.select("m.*", (F.sha2(body, 256) == F.col("m.fingerprint")).alias("fingerprint_fits")).drop("fingerprint")


# Resampling -------------------------------------------------------------------------------------------------------


@query(f"WITH {TICKS}, n AS (SELECT day, row_number() OVER (ORDER BY day) AS place, ntile(5) OVER (ORDER BY day) - 1 AS own FROM (SELECT DISTINCT day FROM ticks)), e AS (SELECT own AS fold, max(place) AS final FROM n GROUP BY own) SELECT CAST(fold AS BIGINT) AS fold, day, CASE WHEN own = fold THEN 'val' WHEN place > final AND place <= final + 2 THEN 'purged' ELSE 'train' END AS role FROM n, e")
def q_purged_folds(spark, d):
    return B.purged_folds(ticks(spark, d), 5, 2).select(F.col("fold").cast("long").alias("fold"), "day", "role")


REPLICATES = 1000


def draws(count: str, size: str, n: str) -> str:
    """The same hash as ``resample.draw``."""
    step = lambda x: f"(({x}) * 48271 + 12345) % 2147483647"
    start = "(rep * 7919 + pos * 104729 + 42) % 2147483647"
    return f"draws AS (SELECT rep, pos, ({step(step(step(start)))}) % ({n} - {size} + 1) AS start FROM (SELECT unnest(range(0, {REPLICATES})) AS rep) a, (SELECT unnest(range(0, {count})) AS pos) b)"


NUMBERED = SCORED + """,
rows AS (SELECT *, row_number() OVER (ORDER BY day, seq) - 1 AS i, """ + ", ".join(f"{ranks(e)} AS r_{n}" for n, e in (("y", "y"), ("a", "yhat"), ("b", "(50 - value)"), ("c", "spread"))) + """ FROM scored),
size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(round(power(count(*), 1.0 / 3), 9)) AS BIGINT) AS len FROM scored)"""
DRAWN = NUMBERED + ", " + draws("(SELECT CAST(ceil(n / len) AS BIGINT) FROM size)", "(SELECT len FROM size)", "(SELECT n FROM size)") + """,
picked AS (SELECT rep, r.* FROM draws, size, rows r WHERE r.i >= start AND r.i < start + len)"""
_IC = "(sum({0} * {1}) - sum({0}) * sum({1}) / count(*)) / sqrt((sum({0} * {0}) - sum({0}) * sum({0}) / count(*)) * (sum({1} * {1}) - sum({1}) * sum({1}) / count(*)))"
METRICS = {
    "ic": _IC.format("r_y", "r_a"),
    "r2": "1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*))",
    "pearson": "(sum(y * yhat) - sum(y) * sum(yhat) / count(*)) / sqrt((sum(y * y) - sum(y) * sum(y) / count(*)) * (sum(yhat * yhat) - sum(yhat) * sum(yhat) / count(*)))",
    "mae": "avg(abs(y - yhat))",
    "rmse": "sqrt(avg((y - yhat) * (y - yhat)))",
    "directional_accuracy": "count(*) FILTER (WHERE y <> 0 AND sign(y) = sign(yhat)) / count(*) FILTER (WHERE y <> 0)",
    "profitable_accuracy": "count(*) FILTER (WHERE abs(y) > 5 AND sign(y) = sign(yhat)) / count(*) FILTER (WHERE abs(y) > 5)",
}


@query(f"WITH {DRAWN}, v AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS metric, rep, {e} AS value FROM picked GROUP BY rep' for k, e in METRICS.items())}), p AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS metric, {e} AS estimate FROM rows' for k, e in METRICS.items())}) SELECT metric, {r('any_value(estimate)', 'estimate')}, {r('quantile_cont(value, 0.025)', 'low')}, {r('quantile_cont(value, 0.975)', 'high')} FROM v JOIN p USING (metric) GROUP BY metric")
def q_block_bootstrap_ci(spark, d):
    rows = materialize(numbered(scored(spark, d).select("day", "seq", "y", "yhat")), "numbered")
    return B.bootstrap_ci(rows, "y", "yhat", rows.count(), REPLICATES)


def _pairwise(metric: str, value: dict[str, str]) -> str:
    each = ", ".join(f"{e} AS {n}" for n, e in value.items())
    delta = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, t.{a} - t.{b} AS delta, o.{a} - o.{b} AS point FROM t, o" for a, b in (("a", "b"), ("a", "c"), ("b", "c")))
    return f"""WITH {DRAWN}, t AS (SELECT rep, {each} FROM picked GROUP BY rep), o AS (SELECT {each} FROM rows), x AS ({delta}),
s AS (SELECT a, b, any_value(point) AS delta, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high, least(1.0, 2 * least(avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END))) AS p FROM x GROUP BY a, b),
q AS (SELECT *, p * 3 / row_number() OVER (ORDER BY p, a, b) AS raw FROM s)
SELECT a, b, '{metric}' AS metric, {r('delta', 'delta')}, {r('low', 'low')}, {r('high', 'high')}, {r('p', 'p')}, {r('least(1.0, min(raw) OVER (ORDER BY p, a, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'q')} FROM q"""


def _treatments(spark, d):
    rows = scored(spark, d).select("day", "seq", "y", F.col("yhat").alias("a"), (50 - F.col("value")).alias("b"), F.col("spread").alias("c"))
    return materialize(numbered(rows), "numbered")


@query(_pairwise("ic", {n: _IC.format("r_y", f"r_{n}") for n in "abc"}))
def q_pairwise_bh(spark, d):
    rows = _treatments(spark, d)
    return B.paired_differences(rows, "y", ["a", "b", "c"], rows.count(), REPLICATES)


@query(_pairwise("mae", {"a": "avg(abs(y - yhat))", "b": "avg(abs(y - (50 - value)))", "c": "avg(abs(y - spread))"}))
def q_pairwise_mae(spark, d):
    rows = _treatments(spark, d)
    return B.paired_differences(rows, "y", ["a", "b", "c"], rows.count(), REPLICATES, metric="mae")


ANEW = 200
REDRAWN = DRAWN.replace(f"range(0, {REPLICATES})", f"range(0, {ANEW})") + f""",
again AS (SELECT rep, {ranks('y', 'rep')} AS ry, {ranks('yhat', 'rep')} AS ra, {ranks('(50 - value)', 'rep')} AS rb, {ranks('spread', 'rep')} AS rc FROM picked),
t AS (SELECT rep, {', '.join(f"{pearson_sql('ry', f'r{n}')} AS {n}" for n in 'abc')} FROM again GROUP BY rep),
o AS (SELECT {', '.join(f"{_IC.format('r_y', f'r_{n}')} AS {n}" for n in 'abc')} FROM rows)"""


@query(f"WITH {REDRAWN} SELECT 'ic' AS metric, {r('any_value(o.a)', 'estimate')}, {r('quantile_cont(t.a, 0.025)', 'low')}, {r('quantile_cont(t.a, 0.975)', 'high')} FROM t, o")
def q_bootstrap_reranked(spark, d):
    rows = materialize(numbered(scored(spark, d).select("day", "seq", "y", "yhat")), "numbered")
    return B.bootstrap_ci(rows, "y", "yhat", rows.count(), ANEW, metrics=("ic",), rerank=True)


@query(f"""WITH {REDRAWN}, x AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, t.{a} - t.{b} AS delta, o.{a} - o.{b} AS point FROM t, o" for a, b in (("a", "b"), ("a", "c"), ("b", "c")))}),
s AS (SELECT a, b, any_value(point) AS delta, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high, least(1.0, 2 * least(avg(CASE WHEN delta <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN delta >= 0 THEN 1.0 ELSE 0.0 END))) AS p FROM x GROUP BY a, b),
q AS (SELECT *, p * 3 / row_number() OVER (ORDER BY p, a, b) AS raw FROM s)
SELECT a, b, 'ic' AS metric, {r('delta', 'delta')}, {r('low', 'low')}, {r('high', 'high')}, {r('p', 'p')}, {r('least(1.0, min(raw) OVER (ORDER BY p, a, b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'q')} FROM q""")
def q_pairwise_reranked(spark, d):
    rows = _treatments(spark, d)
    return B.paired_differences(rows, "y", ["a", "b", "c"], rows.count(), ANEW, rerank=True)


_STEP = lambda x: f"(({x}) * 48271 + 12345) % 2147483647"
_KEY = _STEP(_STEP(_STEP('((42 + rep + f * 3) * 7919 + "to" * 104729) % 2147483647')))
_MOVED = ", ".join(f"CASE WHEN f = {k} THEN s.{c} ELSE r.{c} END AS {c}" for k, c in enumerate(("value", "spread", "k")))
PERMUTED = f"""{NUMBERED}, names AS (SELECT * FROM (VALUES (0, 'value'), (1, 'spread'), (2, 'k')) v(f, feature), (SELECT unnest(range(0, 3)) AS rep) q),
keys AS (SELECT f, feature, rep, "to" FROM names, (SELECT unnest(range(0, (SELECT n // len FROM size))) AS "to") t),
perm AS (SELECT f, feature, rep, "to", row_number() OVER (PARTITION BY f, rep ORDER BY {_KEY}, "to") - 1 AS src FROM keys),
moved AS (
  SELECT feature, rep, r.y, {_MOVED} FROM size, rows r JOIN perm p ON r.i // (SELECT len FROM size) = p."to" JOIN rows s ON s.i = p.src * (SELECT len FROM size) + r.i % (SELECT len FROM size)
  UNION ALL SELECT feature, rep, y, value, spread, k FROM rows, names, size WHERE i >= (n // len) * len
  UNION ALL SELECT '', 0, y, value, spread, k FROM rows),
scores AS (SELECT feature, rep, y, -value + 0.1 * spread + 0.0 * k AS score FROM moved),
ranked AS (SELECT feature, rep, {ranks('y', 'feature, rep')} AS ry, {ranks('score', 'feature, rep')} AS rs FROM scores),
m AS (SELECT feature, rep, {pearson_sql('ry', 'rs')} AS v FROM ranked GROUP BY feature, rep)"""


@query(f"WITH {PERMUTED} SELECT m.feature, {r('any_value(b.v) - avg(m.v)', 'importance')}, {r('stddev_samp(m.v)', 'std')}, {r('any_value(b.v) - quantile_cont(m.v, 0.975)', 'low')}, {r('any_value(b.v) - quantile_cont(m.v, 0.025)', 'high')} FROM m, m b WHERE b.feature = '' AND m.feature <> '' GROUP BY m.feature")
def q_permutation_importance(spark, d):
    rows = materialize(numbered(scored(spark, d).select("day", "seq", "y", "value", "spread", "k")), "numbered")
    score = -F.col("value") + 0.1 * F.col("spread") + 0.0 * F.col("k")
    return B.permutation_importance(rows, ["value", "spread", "k"], "y", score, B.metric_for_task("regression"), rows.count(), 3)


# Models -----------------------------------------------------------------------------------------------------------

LOGITS = "logits AS (SELECT vec_id, label % 3 AS label, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS z FROM embeddings), soft AS (SELECT vec_id, label, z, exp(z[label + 1]) / (exp(z[1]) + exp(z[2]) + exp(z[3])) AS p FROM logits)"


def _logits(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("label") % 3).alias("label"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("logits"))


@query(f"WITH {LOGITS} SELECT label, {r('avg(pow(1 - p, 2) * -ln(p) * [0.5, 1.0, 2.0][label + 1])', 'focal_loss')} FROM soft GROUP BY label")
def q_focal_loss(spark, d):
    return _logits(spark, d).groupBy("label").agg(F.avg(M.focal_loss(F.col("logits"), F.col("label"), 2.0, [0.5, 1.0, 2.0])).alias("focal_loss"))


@query(f"WITH {LOGITS} SELECT {r('sum(-ln(p) * (label + 1)) / sum(label + 1)', 'loss')} FROM soft")
def q_weighted_ce(spark, d):
    rows = _logits(spark, d)
    return rows.agg(M.weighted_mean(M.cross_entropy(F.col("logits"), F.col("label")), F.col("label") + 1).alias("loss"))


@query(f"WITH {LOGITS}, b AS (SELECT label, 1 / (1 + exp(-z[1])) AS p FROM logits), o AS (SELECT CASE WHEN label = 1 THEN p ELSE 1 - p END AS q, CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END AS a FROM b) SELECT {r('avg(-a * pow(1 - q, 2) * ln(q))', 'loss')} FROM o")
def q_binary_focal_loss(spark, d):
    from ..functions.scalar import sigmoid

    rows = _logits(spark, d)
    return rows.agg(F.avg(M.binary_focal_loss(sigmoid(F.get("logits", F.lit(0))), F.col("label"))).alias("loss"))


@query(f"WITH {LOGITS} SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, {r('exp(list_max(z)) / (exp(z[1]) + exp(z[2]) + exp(z[3]))', 'confidence')} FROM soft")
def q_softmax_argmax(spark, d):
    return M.infer(_logits(spark, d)).select("vec_id", "pred", "confidence")


@query(f"WITH {LOGITS}, q AS (SELECT label, unnest([exp(z[1]), exp(z[2]), exp(z[3])]) / (exp(z[1]) + exp(z[2]) + exp(z[3])) AS p, unnest([0, 1, 2]) AS c FROM logits) SELECT c AS class, {r('avg(p)', 'mean_probability')}, {r('avg(CASE WHEN label = c THEN 1.0 ELSE 0.0 END)', 'label_share')} FROM q GROUP BY c")
def q_mean_probabilities(spark, d):
    from ..operators.classification import mean_probabilities

    return mean_probabilities(M.infer(_logits(spark, d)))


_RIDGE = ["l_quantity", "l_extendedprice", "l_tax"]


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _ridge_sql(columns: list[str], label: str, alpha: float, show=r) -> str:
    """The penalized normal equations of centred columns, solved by determinants."""
    sums = ", ".join([f"regr_sxy({a}, {b}) + {alpha if a == b else 0.0} AS s{i}{j}" for i, a in enumerate(columns) for j, b in enumerate(columns)] + [f"regr_sxy({label}, {a}) AS t{i}" for i, a in enumerate(columns)] + [f"avg({c}) AS m{i}" for i, c in enumerate([*columns, label])])
    m = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    put = lambda k: [[f"t{i}" if j == k else m[i][j] for j in range(3)] for i in range(3)]
    w = ", ".join(f"{_det(put(k))} / {_det(m)} AS w{k}" for k in range(3))
    rows = [f"SELECT '{c}' AS feature, {show(f'w{k}', 'weight')} FROM w" for k, c in enumerate(columns)] + [f"SELECT 'intercept', {show('m3 - w0 * m0 - w1 * m1 - w2 * m2', 'weight')} FROM w"]
    return f"WITH l AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [*columns, label])} FROM lineitem), s AS (SELECT {sums} FROM l), w AS (SELECT *, {w} FROM s) " + " UNION ALL ".join(rows)


@query(_ridge_sql(_RIDGE, "l_discount", 1.0))
def q_ridge(spark, d):
    model = M.fit_ridge(table(spark, d, "lineitem"), _RIDGE, "l_discount")
    return spark.createDataFrame([(f, float(c)) for f, c in zip([*_RIDGE, "intercept"], [*model.coefficients, model.intercept])], "feature string, weight double")


@query()
def q_feature_sweep(spark, d):
    rows = with_split(scored(spark, d)).withColumn("k", F.col("k").cast("double"))
    return M.feature_sweep(rows, {"price_level": ["value"], "all": ["value", "spread", "k"]}, 3)


@query()
def q_logistic(spark, d):
    rows = scored(spark, d).select("label", "value", "spread", F.col("k").cast("double").alias("k"))
    features = ["value", "spread", "k"]
    _, model = M.fit_logistic(rows, features, "label", 3)
    return spark.createDataFrame(M.logistic_importance(model, features), "feature string, importance double")


@query()
def q_boosting(spark, d):
    rows = scored(spark, d).select("y", "value", "spread", F.col("k").cast("double").alias("k"), "day", "seq")
    model = M.fit_boosting(rows, ["value", "spread", "k"], "y", trees=20)
    return model.transform(M.assemble(rows, ["value", "spread", "k"])).select("day", "seq", "prediction")


@query()
def q_huber_boosting(spark, d):
    """Forecasts of boosted trees with Huber loss for every labelled tick; held against a plain fit in the tests."""
    from ..operators.boosting import fit_huber_trees, score_trees

    rows = scored(spark, d).select("y", "value", "spread", F.col("k").cast("double").alias("k"), "day", "seq")
    model = fit_huber_trees(rows, ["value", "spread", "k"], "y", trees=5, depth=3)
    return score_trees(rows, model).select("day", "seq", "yhat")


# Monitoring -------------------------------------------------------------------------------------------------------

WR = "WINDOW w AS (PARTITION BY run ORDER BY epoch)"
BEFORE = "(PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
NEW = f"min(val_loss) OVER {BEFORE} IS NULL OR val_loss < min(val_loss) OVER {BEFORE}"


DELTA = 0.4
BETTER = f"o.val_loss < f.best - {DELTA}"


@query(f"""WITH RECURSIVE {EPOCHS}, o AS (SELECT run, epoch, val_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM epochs),
f AS (
  SELECT run, epoch, i, TRUE AS improved, val_loss AS best, CAST(0 AS INTEGER) AS waited, FALSE AS stop FROM o WHERE i = 1
  UNION ALL SELECT o.run, o.epoch, o.i, {BETTER}, CASE WHEN {BETTER} THEN o.val_loss ELSE f.best END, CASE WHEN {BETTER} THEN 0 ELSE f.waited + 1 END, f.stop OR (NOT ({BETTER}) AND f.waited + 1 >= 3) FROM f JOIN o ON o.run = f.run AND o.i = f.i + 1)
SELECT run, epoch, improved, {r('best', 'best')}, waited, stop FROM f""")
def q_early_stopping(spark, d):
    return O.early_stopping(epochs(spark, d), min_delta=DELTA).select("run", "epoch", "improved", "best", "waited", "stop")


@query(f"WITH {EPOCHS} SELECT run, epoch, coalesce(lag(train_loss, 2) OVER w >= lag(train_loss) OVER w AND lag(train_loss) OVER w >= train_loss AND lag(val_loss, 2) OVER w <= lag(val_loss) OVER w AND lag(val_loss) OVER w <= val_loss, FALSE) AS overfit FROM epochs {WR}")
def q_overfit_flags(spark, d):
    return O.overfit_flags(epochs(spark, d)).select("run", "epoch", "overfit")


@query(f"WITH {EPOCHS}, b AS (SELECT *, accuracy = max(accuracy) OVER w AND (max(accuracy) OVER {BEFORE} IS NULL OR accuracy > max(accuracy) OVER {BEFORE}) AS top FROM epochs {WR}) SELECT run, epoch, epoch - max(CASE WHEN top THEN epoch END) OVER w >= 5 AS stagnant, loss > 2.0 * first_value(loss) OVER w AS diverged, epoch > 3 AND accuracy < 0.35 AS weak FROM b {WR}")
def q_health_flags(spark, d):
    return O.health_flags(epochs(spark, d)).select("run", "epoch", "stagnant", "diverged", "weak")


@query(f"WITH {EPOCHS} SELECT run, epoch, {r('val_loss', 'val_loss')}, {r('0.5 * 0.001 * (1 + cos(pi() * epoch / 50)) * 1000', 'cosine')}, {r('pow(0.1, floor(epoch / 10))', 'step')}, 1.0 AS constant FROM epochs")
def q_lr_schedule(spark, d):
    """The epochs of all runs with the rates they were trained at, in thousandths."""
    rate = lambda kind: O.learning_rate(F.col("epoch"), 50, 0.001, kind) * 1000
    return epochs(spark, d).select("run", "epoch", "val_loss", rate("cosine").alias("cosine"), rate("step").alias("step"), rate("none").alias("constant"))


@query(f"WITH {EPOCHS} SELECT run, epoch, {NEW} AS is_best, {NEW} OR (epoch + 1) % 5 = 0 AS save FROM epochs {WR}")
def q_checkpoint_decisions(spark, d):
    return O.checkpoint_decisions(epochs(spark, d)).select("run", "epoch", "is_best", "save")


@query(f"WITH {EPOCHS} SELECT run, epoch FROM epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) <= 3")
def q_keep_last(spark, d):
    return O.keep_last(epochs(spark, d), 3).select("run", "epoch")


@query(f"WITH {TICKS} SELECT day AS run, event_type AS epoch, {r('sqrt(sum(value * value))', 'total_norm')}, {r('avg(value)', 'mean_norm')}, {r('stddev_pop(value)', 'std_norm')}, {r('max(value)', 'max_norm')}, {r('min(value)', 'min_norm')}, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf FROM ticks GROUP BY ALL")
def q_gradient_summary(spark, d):
    return O.gradient_summary(ticks(spark, d).select(F.col("day").alias("run"), F.col("event_type").alias("epoch"), F.col("value").alias("grad_norm")))


@query(f"WITH {EPOCHS} SELECT run, epoch, 'val_f1' AS metric, {r('sqrt(accuracy)', 'value')} FROM epochs UNION ALL SELECT run, epoch, 'precision_up', {r('sqrt(accuracy) / 2', 'value')} FROM epochs")
def q_metric_history(spark, d):
    # Roots, as means of few whole numbers may lie half way between two rounded values.
    logs = F.create_map(F.lit("loss"), F.col("loss"), F.lit("val_f1"), F.sqrt("accuracy"), F.lit("precision_up"), F.sqrt("accuracy") / 2)
    return O.history(epochs(spark, d).withColumn("logs", logs))


@query(f"WITH {EPOCHS} SELECT run, min(epoch) FILTER (WHERE loss = m) AS best_epoch, {r('any_value(m)', 'best_loss')} FROM (SELECT *, min(loss) OVER (PARTITION BY run) AS m FROM epochs) GROUP BY run")
def q_best_epoch(spark, d):
    from ..operators.regression import best_epoch

    return best_epoch(epochs(spark, d), "loss", ["run"])


# Data quality -----------------------------------------------------------------------------------------------------


@query(f"WITH {TICKS}, s AS (SELECT day, 'value' AS feature, value AS x FROM ticks UNION ALL SELECT day, 'k', CAST(k AS DOUBLE) FROM ticks) SELECT day, feature, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf FROM s GROUP BY day, feature")
def q_data_quality(spark, d):
    return V.column_quality(ticks(spark, d), ["value", "k"], ["day"])


@query(f"WITH {SCORED} SELECT label - 1 AS label, count(*) AS n, TRUE AS allowed FROM scored GROUP BY label")
def q_label_domain(spark, d):
    return V.label_domain(scored(spark, d).select((F.col("label") - 1).alias("label")), "label")


@query("SELECT count(*) FILTER (WHERE embedding[64] <> 0) AS n_nonzero FROM embeddings")
def q_reserved_column(spark, d):
    return V.reserved_nonzero(table(spark, d, "embeddings"), 63, "embedding")


@query("SELECT doc_id, regexp_matches(text, '\\d{4}-\\d{2}-\\d{2}') AS has_date, regexp_matches(text, '(?i)\\b(accuracy|ic|r2|mae)\\b') AS has_metric, regexp_matches(text, '(?i)config') AS has_config, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, regexp_matches(text, '\\d{4}-\\d{2}-\\d{2}') AND regexp_matches(text, '(?i)\\b(accuracy|ic|r2|mae)\\b') AND regexp_matches(text, '(?i)config') AS complete FROM documents")
def q_text_audit(spark, d):
    return V.audit_entries(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query(f"WITH {TICKS}, days AS (SELECT day, percent_rank() OVER (ORDER BY day) AS p FROM (SELECT DISTINCT day FROM ticks)) SELECT CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM ticks JOIN days USING (day) GROUP BY 1")
def q_split_sizes(spark, d):
    return with_split(ticks(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKS} SELECT event_type, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, round(stddev_pop(value + 1e9), 3) + 0.0 AS far_std FROM ticks GROUP BY event_type")
def q_merged_moments(spark, d):
    """Of the values, and of values far from 0, where sums of squares would cancel."""
    from ..streaming.moments import batch_moments, finish_moments, merge_moments

    near, far = (finish_moments(merge_moments(batch_moments(ticks(spark, d).withColumn("v", F.col("value") + shift), ["event_type", "day"], "v"), ["event_type"])) for shift in (0.0, 1e9))
    return near.join(far.select("event_type", F.round("std", 3).alias("far_std")), "event_type").select("event_type", "n", "mean", "std", "far_std")


# Kept results, audits and checkpoints -----------------------------------------------------------------------------


_KEPT = {k: METRICS[k] for k in ("mae", "rmse")}


@query(f"WITH {DRAWN}, v AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS metric, rep, {e} AS value FROM picked GROUP BY rep' for k, e in _KEPT.items())}), p AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS metric, {e} AS estimate FROM rows' for k, e in _KEPT.items())}) SELECT metric, {r('any_value(estimate)', 'estimate')}, {r('quantile_cont(value, 0.025)', 'low')}, {r('quantile_cont(value, 0.975)', 'high')}, FALSE AS first_cached, TRUE AS second_cached, FALSE AS other_cached, 'seed: 42 -> 43' AS drift FROM v JOIN p USING (metric) GROUP BY metric")
def q_ci_artifact(spark, d):
    """Asked for twice the intervals are read the second time; another seed is noticed and computed anew."""
    rows = materialize(numbered(scored(spark, d).select("day", "seq", "y", "yhat")), "numbered")
    path = shared_path(spark, "artifacts")
    one = lambda seed: A.ci_artifact(rows, path, "y", "yhat", REPLICATES, seed, metrics=tuple(_KEPT))
    first, second, other = one(42), one(42), one(43)
    return second.table.select("*", F.lit(first.cached).alias("first_cached"), F.lit(second.cached).alias("second_cached"), F.lit(other.cached).alias("other_cached"), F.lit("; ".join(other.drift)).alias("drift"))


_AUDITED = SCORED + """, days AS (SELECT day, percent_rank() OVER (ORDER BY day) AS place FROM (SELECT DISTINCT day FROM scored)),
a AS (SELECT CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'val' ELSE 'test' END AS split, day, label - 1 AS label, spread FROM scored JOIN days USING (day)),
s AS (SELECT split, count(*) AS n, min(day) AS a, max(day) AS b, sum((label = -1)::INT) AS down, sum((label = 0)::INT) AS stable, sum((label = 1)::INT) AS up FROM a GROUP BY split)"""


@query(f"""WITH {_AUDITED}
SELECT split || ' rows' AS rule, CAST(n AS VARCHAR) AS found, TRUE AS ok, 'error' AS level FROM s
UNION ALL SELECT split || ' values that are not finite', '0', TRUE, 'error' FROM s
UNION ALL SELECT split || ' rows without labels', '0', TRUE, 'error' FROM s
UNION ALL SELECT split || ' labels', 'down ' || down || ', stable ' || stable || ', up ' || up || ', other 0', down > 0 AND stable > 0 AND up > 0, 'error' FROM s
UNION ALL SELECT 'order of splits', string_agg(split || ' ' || a || ' to ' || b, '; ' ORDER BY a), TRUE, 'error' FROM s
UNION ALL SELECT 'rows of other splits', '0', TRUE, 'error'
UNION ALL SELECT 'rows without 3 features', '0', TRUE, 'error'
UNION ALL SELECT 'values of feature 2', CAST(sum((spread >= 2)::INT) AS VARCHAR), sum((spread >= 2)::INT) = 0, 'warning' FROM a
UNION ALL SELECT 'features of the manifest', '3', TRUE, 'error'
UNION ALL SELECT 'days of the manifest', '1, written ' || count(DISTINCT day), count(DISTINCT day) = 1, 'warning' FROM a
UNION ALL SELECT 'rows of the manifest', '5, written ' || count(*), count(*) = 5, 'error' FROM a""")
def q_export_audit(spark, d):
    rows = with_split(scored(spark, d)).select("split", "day", "seq", F.array(F.col("value"), F.col("price"), F.floor("spread").cast("double")).alias("features"), F.array(F.col("label") - 1).alias("labels"))
    return write_audited(rows, shared_path(spark, "audited"), 3, {2: (0.0, 1.0)}, {"feature_count": 3, "days_processed": 1, "total_rows": 5})


@query(_ridge_sql(_RIDGE, "l_discount", 1.0, "{} AS {}".format).replace("WITH l AS", "WITH weights AS (WITH l AS", 1) + f""") SELECT l_orderkey, l_linenumber, {r("(SELECT weight FROM weights WHERE feature = 'intercept') + " + " + ".join(f"(SELECT weight FROM weights WHERE feature = '{c}') * {c}" for c in _RIDGE), 'yhat')} FROM lineitem""")
def q_checkpoint_scores(spark, d):
    """A ridge model saved and loaded with its contract scores every row."""
    from ..operators import checkpoints as K

    rows, path = table(spark, d, "lineitem"), shared_path(spark, "checkpoint")
    contract = K.contract_of(rows, _RIDGE, "l_discount", "regression", "ridge of lineitem")
    K.save_checkpoint([M.fit_ridge(rows, _RIDGE, "l_discount")], contract, path, spark)
    model, held = K.load_checkpoint(spark, path, "ridge of lineitem", _RIDGE, "regression")
    return K.score(rows.select("l_orderkey", "l_linenumber", *_RIDGE), model, held).drop(*_RIDGE)


@query(f"""WITH {SCORED}, days AS (SELECT day, percent_rank() OVER (ORDER BY day) AS place FROM (SELECT DISTINCT day FROM scored)),
p AS (SELECT CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'val' ELSE 'test' END AS split, label, pred, lag(label) OVER w AS before FROM scored JOIN days USING (day) {W}),
c AS (SELECT split, before, label, count(*) AS n, avg((label = pred)::INT) AS hit FROM p WHERE before IS NOT NULL GROUP BY ALL),
g AS (SELECT DISTINCT split, b AS before, l AS label FROM c, (SELECT unnest([0, 1, 2]) AS b), (SELECT unnest([0, 1, 2]) AS l))
SELECT split, before, label, coalesce(n, 0) AS n, {r('coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY split, before)', 'share')}, {r('coalesce(hit, 0)', 'hit')} FROM g LEFT JOIN c USING (split, before, label)""")
def q_transition_report(spark, d):
    return E.transition_report(with_split(scored(spark, d)))
