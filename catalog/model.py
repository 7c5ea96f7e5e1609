"""Queries for model fits. Those without SQL are checked by brute force in the tests."""

import zlib
from itertools import combinations

from pyspark.sql import functions as F

from catalog.common import HOURLY_CAL, PREDS, register, shape
from catalog.linear_sql import ridge_ctes, score
from catalog.metrics import preds
from catalog.profile import CUT, split
from catalog.window import EVENT_TYPES, W, WIDE, hourly, pair_corr_sql, roll
from panelkit.functions import scalar as S
from panelkit.functions.contract import wall_clock
from panelkit.operators import folds as G
from panelkit.operators import metrics as H
from panelkit.operators import model as M
from panelkit.operators import onepass as O
from panelkit.operators import profile as P
from panelkit.operators import recursion as R
from panelkit.operators import window as Wn
from panelkit.plans.trees import grow
from panelkit.sources.io import materialize

X = ["load_forecast_lag_1", "load_forecast_lag_24", "target_roll_mean_24", "load_forecast", "hour"]


def features(s, d):
    """Hourly panel with lag, rolling, cross-section and calendar features."""
    df, spec = hourly(s, d, "ts")
    df = Wn.lags(df, spec, ["load_forecast"], [1, 24])
    df = Wn.rolling(df, spec, ["target"], [24], ["mean"])
    df = Wn.cross_section(df, spec, ["w1"])
    return materialize(df), spec


def test_part(df):
    return df.filter(F.col("ts") >= wall_clock(CUT))


# --- linear fits ---------------------------------------------------------------------------


def _ridge_one(s, d):
    df, spec = hourly(s, d)
    table = M.grouped_ridge(split(df), ["entity"], ["w2"], "target", spec, 25.0)
    return M.predict_ridge(df, table, ["entity"], ["w2"], spec)


def ridge_sql(rows: str, by: str, x: str, y: str) -> str:
    """Coefficients of a one-feature ridge per group, from its closed form."""
    return f"""(SELECT {by}, any_value(med) AS med, avg({y}) - covar_pop(fx, {y}) * count(*) / (sqrt(var_pop(fx)) * (count(*) + 25.0::DOUBLE))
        / sqrt(var_pop(fx)) * avg(fx) AS icept,
        covar_pop(fx, {y}) * count(*) / (sqrt(var_pop(fx)) * (count(*) + 25.0::DOUBLE)) / sqrt(var_pop(fx)) AS coef
      FROM (SELECT *, coalesce({x}, med) AS fx FROM (SELECT *, median({x}) OVER (PARTITION BY {by}) AS med FROM {rows}))
      GROUP BY {by})"""


register(
    "J1_grouped_ridge_one",
    shape("entity ts", "", "pred", 5),
    _ridge_one,
    f"""WITH {HOURLY_CAL}, train AS (SELECT * FROM cal WHERE ts < TIMESTAMP '{CUT}'),
      m AS {ridge_sql("train", "entity", "w2", "target")}
      SELECT entity, ts, icept + coef * coalesce(w2, med) AS pred FROM cal JOIN m USING (entity)""",
)


def _ridge(s, d):
    df, spec = features(s, d)
    table = M.grouped_ridge(split(df), ["entity"], X, "target", spec)
    return M.predict_ridge(df, table, ["entity"], X, spec)


# The columns of ``features`` under the names of X.
FEATURES = f"""{HOURLY_CAL}, feat AS (SELECT *, lag(load_forecast, 1) OVER w AS load_forecast_lag_1,
    lag(load_forecast, 24) OVER w AS load_forecast_lag_24, w1 - avg(w1) OVER (PARTITION BY ts) AS w1_xmk_diff,
    avg(target) OVER (PARTITION BY entity ORDER BY ts, id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS target_roll_mean_24
  FROM cal {W})"""
TRAIN = f"train AS (SELECT * FROM feat WHERE ts < TIMESTAMP '{CUT}')"
TEST = f"ts >= TIMESTAMP '{CUT}'"
register(
    "J1_grouped_ridge",
    shape("entity ts", "", "target pred", 5),
    _ridge,
    f"""WITH RECURSIVE {FEATURES}, {TRAIN}, {ridge_ctes("m", "train", "entity", X, "target")}
      SELECT entity, ts, target, {score(X)} AS pred FROM feat JOIN m USING (entity)""",
)


def _stack(s, d):
    df, _ = preds(s, d)
    return M.nonneg_stack(df, ["p1", "p3"], 50.0)


SOLVE = """SELECT *, ((g12 + 0) IS NOT NULL) AS ok,
    greatest(0, (t1 * (g22 + lam) - t2 * g12) / ((g11 + lam) * (g22 + lam) - g12 * g12)) AS u1,
    greatest(0, (t2 * (g11 + lam) - t1 * g12) / ((g11 + lam) * (g22 + lam) - g12 * g12)) AS u2"""
PRODUCTS = """sum(p1 * p1) AS g11, sum(p1 * p3) AS g12, sum(p3 * p3) AS g22,
    sum(p1 * target) AS t1, sum(p3 * target) AS t2"""
register(
    "J2_nonneg_stack",
    shape("model", "", "weight rmse"),
    _stack,
    f"""WITH {PREDS}, g AS (SELECT 50.0::DOUBLE AS lam, {PRODUCTS} FROM pe), s AS ({SOLVE} FROM g)
      SELECT 'p1' AS model, u1 / (u1 + u2) AS weight, (SELECT sqrt(avg((p1 - target) ** 2)) FROM pe) AS rmse FROM s
      UNION ALL SELECT 'p3', u2 / (u1 + u2), (SELECT sqrt(avg((p3 - target) ** 2)) FROM pe) FROM s""",
)

LAMBDAS = [0.0, 10.0, 1000.0, 1e6, 1e8]


def _lambda(s, d):
    df, spec = preds(s, d)
    return M.lambda_search(df, ["p1", "p3"], LAMBDAS, G.stack_folds(df, spec, 4, 14), spec)


register(
    "J3_lambda_search",
    shape("mode", "n_folds", "lambda rmse_cv"),
    _lambda,
    f"""WITH {PREDS}, days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n
        FROM (SELECT DISTINCT ts::DATE AS d FROM pe)),
      f AS (SELECT k, (SELECT d FROM days WHERE p = 14 + k * (n // 5)) AS vs,
          (SELECT d FROM days WHERE p = least(14 + (k + 1) * (n // 5), n) - 1) + INTERVAL 1 DAY AS ve
        FROM (SELECT DISTINCT n FROM days), range(4) AS r(k) WHERE 14 + k * (n // 5) < n),
      g AS (SELECT k, lam, {PRODUCTS} FROM f, (VALUES (0.0::DOUBLE), (10), (1000), (1e6), (1e8)) AS l(lam), pe
        WHERE ts < vs GROUP BY ALL),
      s AS ({SOLVE} FROM g),
      e AS (SELECT k, lam, sqrt(avg(((u1 * p1 + u2 * p3) / (u1 + u2) - target) ** 2)) AS r, count(*) AS n
        FROM s JOIN f USING (k), pe WHERE ts >= vs AND ts < ve GROUP BY ALL)
      SELECT 'time_walk_forward' AS mode, count(*) AS n_folds, lam AS "lambda", sum(r * n) / sum(n) AS rmse_cv
      FROM e GROUP BY lam""",
)


def _prune(s, d):
    df, _ = preds(s, d)
    df = df.withColumns({"p4": F.col("p1") * 2.0 + 1.0, "p5": F.col("p3") + 0.01 * F.col("p2")})
    return M.corr_prune(df, ["p1", "p2", "p3", "p4", "p5"], 0.9)[1]


_FIVE = [f"p{i}" for i in range(1, 6)]
register(
    "J4_corr_prune",
    shape("dropped kept", "step", "pair_corr rmse_dropped rmse_kept"),
    _prune,
    f"""WITH RECURSIVE {PREDS}, x AS (SELECT *, p1 * 2.0::DOUBLE + 1.0::DOUBLE AS p4, p3 + 0.01::DOUBLE * p2 AS p5 FROM pe),
      err AS (SELECT * FROM (SELECT {", ".join(f"sqrt(avg(({p} - target) ** 2)) AS {p}" for p in _FIVE)} FROM x)
        UNPIVOT (e FOR m IN ({", ".join(_FIVE)}))),
      pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM x" for a, b in combinations(_FIVE, 2))}),
      strong AS (SELECT *, row_number() OVER (ORDER BY r DESC, a, b) AS place FROM (
        SELECT r, CASE WHEN ea.e > eb.e THEN a ELSE b END AS dropped, CASE WHEN ea.e > eb.e THEN b ELSE a END AS kept, a, b,
          greatest(ea.e, eb.e) AS worse, least(ea.e, eb.e) AS better
        FROM pairs JOIN err ea ON ea.m = a JOIN err eb ON eb.m = b WHERE r > 0.9)),
      walk AS (SELECT CAST(0 AS BIGINT) AS place, []::VARCHAR[] AS gone, CAST(0 AS BIGINT) AS step, FALSE AS hit UNION ALL
        SELECT s.place, CASE WHEN free THEN list_append(gone, dropped) ELSE gone END, step + free::BIGINT, free
        FROM (SELECT s.*, w.gone, w.step, NOT list_contains(w.gone, s.a) AND NOT list_contains(w.gone, s.b) AS free
          FROM walk w JOIN strong s ON s.place = w.place + 1) s)
      SELECT dropped, kept, step, r AS pair_corr, worse AS rmse_dropped, better AS rmse_kept
      FROM walk JOIN strong USING (place) WHERE hit""",
)

# --- global and local models ---------------------------------------------------------------

SCORES = shape("family", "n", "rmse rmse_of_mean")


def _score(df, spec, family):
    err, mean = F.col("pred") - F.col("target"), F.col("profile_m_mean") - F.col("target")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sqrt(F.avg(mean * mean)).alias("rmse_of_mean"),
    ).withColumn("family", F.lit(family))


def _with_mean(df, spec):
    return P.join_table(df, P.profile(split(df), ["entity"], "profile_m"), ["entity"], spec)


TREES = {"gbt": {"maxIter": 10, "maxDepth": 4}, "forest": {"numTrees": 20, "maxDepth": 6}}


def _global(s, d):
    df, spec = features(s, d)
    df = _with_mean(df, spec)
    out = None
    for family in M.FAMILIES:
        model = M.fit_global(split(df), X, "target", family, spec, ["entity"], **TREES.get(family, {}))
        part = _score(model.predict(test_part(df)), spec, family)
        out = part if out is None else out.unionByName(part)
    return out


register("J5_fit_global", SCORES, _global)


def _local(s, d):
    df, spec = features(s, d)
    df = _with_mean(df, spec)
    top = M.fit_global(split(df), X, "target", "ridge", spec)
    rows = materialize(top.predict(df, "global_pred"))
    # One entity is left out of the fit and takes the global prediction.
    train = split(rows).filter("entity <> 'view'")
    linear = M.fit_local(train, X, "target", spec)
    trees = M.fit_local(train, X, "target", spec, "gbt", trees=10, depth=3)
    out = _score(linear.predict(test_part(rows)), spec, "ridge")
    return out.unionByName(_score(trees.predict(test_part(rows)), spec, "gbt"))


register("J6_fit_local", SCORES, _local)


def _date_folds(df, spec, n=3):
    return G.rolling_date_folds(df, spec, n, 4, 4, 10)


def _global_oof(s, d):
    df, spec = features(s, d)
    return M.global_oof(df, _date_folds(df, spec), X, spec, "ridge")


register("J7_global_oof", shape("id", "fold", "pred"), _global_oof)


def _residual_stack(s, d):
    df, spec = features(s, d)
    train = split(df)
    top, local = M.residual_stack(train, G.rolling_date_folds(train, spec, 2, 4, 4, 8), X, spec)
    return local.predict(top.predict(test_part(df), "global_pred"))


register("J8_residual_stack", shape("entity ts", "id", "target global_pred pred"), _residual_stack)


def _oof_one(s, d):
    df, spec = hourly(s, d)
    df = Wn.lags(df, spec, ["load_forecast"], [24])
    x = ["load_forecast_lag_24"]

    def fit_predict(train, val):
        table = M.grouped_ridge(train, ["entity"], x, "target", spec)
        return M.predict_ridge(val, table, ["entity"], x, spec)

    return M.walk_forward(df, _date_folds(df, spec), spec, fit_predict)


OOF = shape("entity ts", "id fold", "target pred", 5)
OOF_SQL = f"""WITH {HOURLY_CAL}, x AS (SELECT *, lag(load_forecast, 24) OVER w AS lg FROM cal {W}),
      f AS (SELECT 3 - i AS fold, ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i) DAY)::TIMESTAMP AS ve,
        ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i + 4) DAY)::TIMESTAMP AS vs FROM range(3) AS r(i)),
      train AS (SELECT x.*, fold FROM x JOIN f ON ts < vs),
      m AS {ridge_sql("train", "entity, fold", "lg", "target")}
      SELECT entity, ts, id, fold, target, icept + coef * coalesce(lg, med) AS pred
      FROM x JOIN f ON ts >= vs AND ts < ve JOIN m USING (entity, fold)"""
register("J9_walk_forward_oof", OOF, _oof_one, OOF_SQL)


def _one_pass(s, d):
    df, spec = hourly(s, d)
    df = Wn.lags(df, spec, ["load_forecast"], [24])
    return O.walk_forward_ridge(df, _date_folds(df, spec), spec, ["load_forecast_lag_24"])


register("J9_walk_forward_one_pass", OOF, _one_pass, OOF_SQL)


def _walk_forward(s, d):
    """Features, splits, ridge and error table of the flagship query."""
    df, spec = features(s, d)
    profiles = {"profile_mh_mean": ["entity", "hour"], "profile_m_mean": ["entity"]}
    oof = O.walk_forward_ridge(df, _date_folds(df, spec, 3), spec, [*X, "w1_xmk_diff"], profiles)
    return H.error_metrics(oof, spec, "entity")


FLAGSHIP = [*X, "w1_xmk_diff", "profile_mh_mean", "profile_m_mean"]
register(
    "J9_walk_forward_errors",
    shape("entity", "n", "rmse mae bias p90_abs_error p95_abs_error", 5),
    _walk_forward,
    f"""WITH RECURSIVE {FEATURES},
      f AS (SELECT 3 - i AS fold, ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i) DAY)::TIMESTAMP AS ve,
        ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i + 4) DAY)::TIMESTAMP AS vs FROM range(3) AS r(i)),
      early AS (SELECT feat.*, fold FROM feat JOIN f ON ts < vs),
      mh AS (SELECT entity, hour, fold, avg(target) AS profile_mh_mean FROM early GROUP BY ALL),
      me AS (SELECT entity, fold, avg(target) AS profile_m_mean FROM early GROUP BY ALL),
      train AS (SELECT * FROM early JOIN mh USING (entity, hour, fold) JOIN me USING (entity, fold)),
      {ridge_ctes("m", "train", "entity, fold", FLAGSHIP, "target")},
      val AS (SELECT feat.*, fold, profile_mh_mean, profile_m_mean FROM feat JOIN f ON ts >= vs AND ts < ve
        LEFT JOIN mh USING (entity, hour, fold) LEFT JOIN me USING (entity, fold)),
      e AS (SELECT entity, {score(FLAGSHIP)} - target AS err FROM val JOIN m USING (entity, fold))
      SELECT entity, count(*) AS n, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae, avg(err) AS bias,
        quantile_cont(abs(err), 0.9::DOUBLE) AS p90_abs_error, quantile_cont(abs(err), 0.95::DOUBLE) AS p95_abs_error
      FROM e GROUP BY entity""",
)

# --- tails, gates, uplift ------------------------------------------------------------------


def _labels(s, d):
    df, spec = preds(s, d)
    df = M.tail_labels(df, "upper", spec, 0.9, out="upper")
    df = M.tail_labels(df, "two_sided", spec, 0.9, 0.1, out="two_sided")
    df = M.tail_labels(df, "abs", spec, 0.9, out="absolute")
    df = M.tail_labels(df, "upper", spec, 0.9, by_hour=True, hour_min_rows=84, out="by_hour")
    return M.class_balance(M.tail_weights(df, spec), "upper")


def _q(p: float, by: str = "entity") -> str:
    return f"quantile_cont(target, {p}::DOUBLE) OVER (PARTITION BY {by})"


register(
    "J10_tail_labels",
    shape("id", "upper two_sided absolute by_hour", "spike_weight peak_weight class_weight"),
    _labels,
    f"""WITH {PREDS}, q AS (SELECT *, {_q(0.9)} AS h, {_q(0.1)} AS l, {_q(0.95)} AS h95, {_q(0.05)} AS l5,
        quantile_cont(abs(target), 0.9::DOUBLE) OVER (PARTITION BY entity) AS a,
        {_q(0.9, "entity, hour")} AS hh, count(*) OVER (PARTITION BY entity, hour) AS n FROM pe),
      u AS (SELECT *, (target >= h)::INT AS upper FROM q)
      SELECT id, upper, (target >= h OR target <= l)::INT AS two_sided, (abs(target) >= a)::INT AS absolute,
        (target >= CASE WHEN n >= 84 THEN hh ELSE h END)::INT AS by_hour,
        CASE WHEN target <= l5 THEN 3 WHEN target >= h95 THEN 4 ELSE 1 END AS spike_weight,
        CASE WHEN abs(target) >= a THEN 5 ELSE 1 END AS peak_weight,
        CASE WHEN upper = 1 THEN greatest(1, (count(*) OVER () - sum(upper) OVER ()) / greatest(sum(upper) OVER (), 1))
          ELSE 1 END AS class_weight FROM u""",
)


def _gate(s, d):
    df, spec = features(s, d)
    df = M.tail_labels(df, "upper", spec, 0.9)
    gate = M.fit_gate(split(df), X, "tail_label", spec)
    skipped = M.fit_gate(split(df), X, "tail_label", spec, min_class=10**9)
    return skipped.predict(gate.predict(test_part(df), "prob"), "default_prob")


register("J11_fit_gate", shape("entity ts", "tail_label", "prob default_prob"), _gate)


def _focus(s, d):
    df, spec = preds(s, d)
    df = df.withColumn("prob", 1.0 / (1.0 + F.exp((F.lit(50.0) - F.col("target")) / 20.0)))
    df = M.focus_mask(df, spec, "p3", "prob", 300, "in_focus")
    return M.focus_mask(df, spec, "p3", "prob", 10**9, "narrow")


register(
    "J12_focus_mask",
    shape("id", "in_focus narrow"),
    _focus,
    f"""WITH {PREDS}, x AS (SELECT *, abs(target - p3) AS r,
        1.0::DOUBLE / (1.0::DOUBLE + exp((50.0::DOUBLE - target) / 20.0::DOUBLE)) AS prob FROM pe),
      q AS (SELECT quantile_cont(r, 0.95::DOUBLE) AS r95, quantile_cont(r, 0.9::DOUBLE) AS r90,
        quantile_cont(prob, 0.9::DOUBLE) AS p90 FROM x)
      SELECT id, (r >= r95 OR prob >= p90)::INT AS in_focus, (r >= r90)::INT AS narrow FROM x, q""",
)


def _uplift(s, d):
    df, spec = features(s, d)
    df = df.withColumns(
        {"base": F.col("target_roll_mean_24"), "prob": F.col("hour") / 24.0}
    ).filter("base IS NOT NULL")
    model = M.fit_uplift(split(df), X, spec, "base", "prob", min_rows=100, maxIter=5, maxDepth=3)
    return model.predict(test_part(df), "uplift")


register("J12_fit_uplift", shape("entity ts", "", "base uplift"), _uplift)

# --- recursive forecast --------------------------------------------------------------------


def _recursive(s, d):
    df, spec = hourly(s, d)
    lag_steps, windows = (1, 2, 24), (24, 48)
    both = Wn.lags(df, spec, ["target"], lag_steps)
    both = Wn.rolling(both, spec, ["target"], windows, ["mean", "std"])
    x = ["load_forecast", "hour"]
    hist = M.history_features(lag_steps, windows)
    train = split(both)
    table = materialize(M.grouped_ridge(train, ["entity"], [*x, *hist], "target", spec))
    direct = M.grouped_ridge(train, ["entity"], x, "target", spec)
    ahead = M.predict_ridge(test_part(df), direct, ["entity"], x, spec, "direct")
    return M.recursive_forecast(
        split(df), ahead, table, x, spec, 12, "direct", lag_steps, windows
    )


def _history_sql(h: str) -> list[str]:
    """The history features of ``_recursive`` from a list of past values."""
    out = [f"{h}[-{k}]" for k in (1, 2, 24)]
    for n in (24, 48):
        tail = f"{h}[-{n}:]"
        out += [f"list_avg({tail})", f"CASE WHEN len({tail}) > 1 THEN list_stddev_samp({tail}) WHEN len({tail}) = 1 THEN 0 END"]
    return out


_FED = ["load_forecast", "hour", "l1", "l2", "l24", "rm24", "rs24", "rm48", "rs48"]
register(
    "J13_recursive_forecast",
    shape("entity ts", "id", "pred", 5),
    _recursive,
    f"""WITH RECURSIVE {HOURLY_CAL}, lagged AS (SELECT *, lag(target, 1) OVER w AS l1, lag(target, 2) OVER w AS l2,
        lag(target, 24) OVER w AS l24, {roll("target", 24, "mean", 1)} AS rm24, {roll("target", 24, "std", 2)} AS rs24,
        {roll("target", 48, "mean", 1)} AS rm48, {roll("target", 48, "std", 2)} AS rs48 FROM cal {W}),
      train AS (SELECT * FROM lagged WHERE ts < TIMESTAMP '{CUT}'),
      {ridge_ctes("m", "train", "entity", _FED, "target")}, {ridge_ctes("dr", "train", "entity", ["load_forecast", "hour"], "target")},
      ahead AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, id) AS place FROM cal WHERE {TEST}),
      past AS (SELECT entity, list(target ORDER BY ts, id) AS h FROM train GROUP BY entity),
      steps AS (SELECT entity, CAST(0 AS BIGINT) AS place, h, CAST(NULL AS DOUBLE) AS pred FROM past
        UNION ALL SELECT entity, place, list_append(h, p), p FROM (
          SELECT a.entity, a.place, h, {score(["load_forecast", "hour", *_history_sql("h")], "m")} AS p
          FROM steps s JOIN ahead a ON a.entity = s.entity AND a.place = s.place + 1 JOIN m ON m.entity = s.entity
          WHERE s.place < 12))
      SELECT a.entity, ts, id, CASE WHEN a.place <= 12 THEN s.pred ELSE {score(["load_forecast", "hour"], "dr")} END AS pred
      FROM ahead a JOIN dr USING (entity) LEFT JOIN steps s ON s.entity = a.entity AND s.place = a.place""",
)


def _ridge_on(rows, x, spec):
    return R.LinearModels(materialize(M.grouped_ridge(rows, ["entity"], x, "target", spec)), x)


def _ahead(s, d):
    """Training rows with history features, and the horizon with a direct prediction and the entity's mean."""
    df, spec = hourly(s, d)
    lag_steps, windows = (1, 2, 24), (24, 48)
    both = Wn.rolling(Wn.lags(df, spec, ["target"], lag_steps), spec, ["target"], windows, ["mean", "std"])
    train = materialize(split(both))
    direct = M.grouped_ridge(train, ["entity"], ["load_forecast"], "target", spec)
    ahead = M.predict_ridge(test_part(_with_mean(df, spec)), direct, ["entity"], ["load_forecast"], spec, "direct")
    return train, ahead, spec, lag_steps, windows


def _mixture(s, d):
    """Linear models of the last value and, in the upper tail, of the value a day before."""
    train, ahead, spec, lag_steps, windows = _ahead(s, d)
    upper = M.tail_labels(train, "upper", spec, 0.8).filter("tail_label = 1")
    models = R.Mixture(_ridge_on(train, ["target_lag_1"], spec), _ridge_on(upper, ["target_lag_24"], spec))
    return R.recursive_mixture(train, ahead, models, spec, 12, "direct", "profile_m_mean", 48, lag_steps, windows)


register(
    "J13_mixed_recursion",
    shape("entity ts part", "id", "pred", 5),
    _mixture,
    f"""WITH RECURSIVE {HOURLY_CAL}, lagged AS (SELECT *, lag(target, 1) OVER w AS l1, lag(target, 24) OVER w AS l24 FROM cal {W}),
      train AS (SELECT * FROM lagged WHERE ts < TIMESTAMP '{CUT}'),
      upper AS (SELECT * FROM (SELECT *, quantile_cont(target, 0.8::DOUBLE) OVER (PARTITION BY entity) AS q FROM train) WHERE target >= q),
      nm AS {ridge_sql("train", "entity", "l1", "target")}, sp AS {ridge_sql("upper", "entity", "l24", "target")},
      dr AS {ridge_sql("train", "entity", "load_forecast", "target")},
      ahead AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, id) AS place FROM cal WHERE ts >= TIMESTAMP '{CUT}'),
      past AS (SELECT entity, list(target ORDER BY ts, id) AS h, avg(target) AS mean FROM train GROUP BY entity),
      steps AS (SELECT entity, 0 AS place, h, CAST(NULL AS DOUBLE) AS pred FROM past
        UNION ALL SELECT entity, place + 1, list_append(h, p), p FROM (SELECT s.entity, place, h,
          0.85::DOUBLE * (nm.icept + nm.coef * coalesce(h[-1], nm.med)) + 0.15::DOUBLE * (sp.icept + sp.coef * coalesce(h[-24], sp.med)) AS p
          FROM steps s JOIN nm USING (entity) JOIN sp USING (entity) WHERE place < 12))
      SELECT a.entity, ts, id, CASE WHEN a.place <= 12 THEN 'near' WHEN a.place <= 60 THEN 'mid' ELSE 'far' END AS part,
        CASE WHEN a.place <= 12 THEN s.pred WHEN a.place <= 60 THEN dr.icept + dr.coef * coalesce(load_forecast, dr.med) ELSE mean END AS pred
      FROM ahead a JOIN dr USING (entity) JOIN past USING (entity) LEFT JOIN steps s ON s.entity = a.entity AND s.place = a.place""",
)


def _mixture_of_trees(s, d):
    """A boosted model per entity, a forest of the upper tail over all entities, and a boosted gate."""
    train, ahead, spec, lag_steps, windows = _ahead(s, d)
    x = ["load_forecast", "hour", *M.history_features(lag_steps, windows)]
    labelled = M.tail_labels(train, "upper", spec, 0.8)
    models = R.Mixture(
        grow(train, "entity", x, "target", spec, trees=10, depth=3),
        M.fit_global(labelled.filter("tail_label = 1"), x, "target", "forest", spec, ["entity"], numTrees=10),
        M.fit_gate(labelled, x, "tail_label", spec, "gbt", ["entity"], maxIter=5, maxDepth=3),
    )
    return R.recursive_mixture(train, ahead, models, spec, 12, "direct", "profile_m_mean", 48, lag_steps, windows)


register("J13_mixed_trees", shape("entity ts part", "id", "pred", 5), _mixture_of_trees)

# --- feature groups and importance ---------------------------------------------------------

GROUPED = ["target", "load_forecast", "wind_forecast", "solar_forecast", "residual_load", "w1", "w2"]


def _groups(s, d):
    df, _ = hourly(s, d)
    return M.correlation_groups(df, GROUPED, 0.6)


register(
    "J14_correlation_groups",
    shape("group_id feature", "group_size", "corr_threshold"),
    _groups,
    f"""WITH RECURSIVE {HOURLY_CAL}, f AS (SELECT id, feature, v FROM (SELECT id, {", ".join(GROUPED)} FROM cal)
        UNPIVOT INCLUDE NULLS (v FOR feature IN ({", ".join(GROUPED)}))),
      links AS (SELECT p.feature AS a, q.feature AS b FROM f p JOIN f q USING (id) GROUP BY ALL
        HAVING p.feature = q.feature OR abs(corr(p.v, q.v)) >= 0.6),
      reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
      parts AS (SELECT a AS feature, count(*) AS group_size, string_agg(b, '|' ORDER BY b) AS members
        FROM reach GROUP BY a)
      SELECT feature, group_size, 0.6 AS corr_threshold, 'group_' || md5(members)[1:12] AS group_id FROM parts""",
)


def _permutation(s, d):
    df, spec = features(s, d)
    table = materialize(M.grouped_ridge(split(df), ["entity"], X, "target", spec))

    def predict(rows):
        return M.predict_ridge(rows, table, ["entity"], X, spec)

    return M.permutation_importance(test_part(df), predict, PERMUTED, spec)


def _ridge_importance(s, d):
    df, spec = features(s, d)
    table = materialize(M.grouped_ridge(split(df), ["entity"], X, "target", spec))
    return M.ridge_importance(test_part(df), table, ["entity"], X, PERMUTED, spec)


PERMUTED = {"load": ["load_forecast"], "lags": X[:2], "unused": ["w2"]}
_swapped = {
    name: [f"coalesce({'s' if c in cols else 'v'}.{c}, fills[{i}])" for i, c in enumerate(X, 1)]
    for name, cols in {"": [], **PERMUTED}.items()
}
PERMUTED_SHAPE = shape("name", "fold group_size n_val_rows", "baseline_rmse rmse_permuted delta", 5)
PERMUTED_SQL = f"""WITH RECURSIVE {FEATURES}, {TRAIN}, {ridge_ctes("m", "train", "entity", X, "target")},
  v AS (SELECT *, row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS pos, count(*) OVER () AS n FROM feat WHERE {TEST}),
  g(name, size, hash) AS (VALUES {", ".join(f"('{n}', {len(c)}, {zlib.crc32(f'42/1/{n}'.encode())})" for n, c in PERMUTED.items())}),
  e AS (SELECT g.name, size, v.target, CASE g.name {" ".join(f"WHEN '{n}' THEN icept + " + " + ".join(f"coefs[{i}] * {c}" for i, c in enumerate(_swapped[n], 1)) for n in PERMUTED)} END AS p,
      icept + {" + ".join(f"coefs[{i}] * {c}" for i, c in enumerate(_swapped[""], 1))} AS base
    FROM v JOIN g ON TRUE JOIN v s ON s.pos = (v.pos + 1 + hash % (v.n - 1)) % v.n JOIN m ON m.entity = v.entity)
  SELECT name, 1 AS fold, any_value(size) AS group_size, count(*) AS n_val_rows, sqrt(avg((base - target) ** 2)) AS baseline_rmse,
    sqrt(avg((p - target) ** 2)) AS rmse_permuted, sqrt(avg((p - target) ** 2)) - sqrt(avg((base - target) ** 2)) AS delta
  FROM e GROUP BY name"""
register("J15_permutation_importance", PERMUTED_SHAPE, _permutation, PERMUTED_SQL)
register("J15_ridge_importance", PERMUTED_SHAPE, _ridge_importance, PERMUTED_SQL)


def _summary(s, d):
    df, spec = preds(s, d)
    a, b = F.col("p1") - F.col("target"), F.col("p2") - F.col("target")
    perm = df.groupBy(F.col("entity").alias("name"), "fold").agg(
        (F.sqrt(F.avg(b * b)) - F.sqrt(F.avg(a * a))).alias("delta"), F.lit(2).alias("group_size")
    )
    return M.importance_summary(perm, spec)


register(
    "J16_importance_summary",
    shape("name", "group_size positive_fold_count n_folds", "mean_delta median_delta std_delta"),
    _summary,
    f"""WITH {PREDS}, p AS (SELECT entity AS name, fold,
        sqrt(avg((p2 - target) * (p2 - target))) - sqrt(avg((p1 - target) * (p1 - target))) AS delta FROM pe GROUP BY ALL)
      SELECT name, 2 AS group_size, avg(delta) AS mean_delta, median(delta) AS median_delta,
        coalesce(stddev_samp(delta), 0) AS std_delta, count(*) FILTER (delta > 0) AS positive_fold_count,
        count(*) AS n_folds FROM p GROUP BY name""",
)

# --- peers and specialists -----------------------------------------------------------------


def _peers(s, d):
    df, spec = hourly(s, d)
    df = df.withColumn("global_pred", F.col("target") * 0.5 + F.col("w1") * 0.1)
    return M.peer_features(df, spec, EVENT_TYPES, split(df), lookback=48, min_periods=12)


PEER = f"""{HOURLY_CAL}, hist AS (SELECT * FROM cal WHERE ts < TIMESTAMP '{CUT}'),
  g AS (SELECT *, target * 0.5::DOUBLE + w1 * 0.1::DOUBLE AS gp FROM cal),
  names AS (SELECT DISTINCT entity AS o FROM cal),
  {WIDE.format(cond="a.entity <> b.entity").replace("FROM panel", "FROM hist").replace("JOIN panel", "JOIN hist")},
  series AS ({pair_corr_sql(48, 12)}),
  last AS (SELECT a, b, arg_max(corr, ts) FILTER (corr IS NOT NULL) AS last FROM series GROUP BY ALL),
  plain AS (SELECT a, b, corr(x, y) AS plain FROM full_pairs GROUP BY ALL),
  r AS (SELECT g.id, o, coalesce(q.gp, g.gp) AS v,
      coalesce(s.corr, last, plain, 0) AS c
    FROM g CROSS JOIN names LEFT JOIN g q ON q.ts = g.ts AND q.entity = o
    LEFT JOIN series s ON s.a = g.entity AND s.b = o AND s.ts = g.ts
    LEFT JOIN last ON last.a = g.entity AND last.b = o
    LEFT JOIN plain ON plain.a = g.entity AND plain.b = o
    WHERE o <> g.entity),
  agg AS (SELECT id, avg(v) AS peer_mean, median(v) AS peer_median, stddev_samp(v) AS peer_std,
    sum(c * v) AS num, sum(abs(c)) AS den,
    max(v) FILTER (o = 'click') AS vc, max(v) FILTER (o = 'view') AS vv FROM r GROUP BY id)"""
register(
    "J17_peer_features",
    shape(
        "entity ts",
        "",
        "peer_mean peer_median peer_std peer_corr_signal peer_corr_strength pred_click spread_vs_view",
        5,
    ),
    _peers,
    f"""WITH {PEER} SELECT entity, ts, peer_mean, peer_median, peer_std,
      CASE WHEN den > 1e-6 THEN num / den ELSE peer_mean END AS peer_corr_signal, den / 4 AS peer_corr_strength,
      coalesce(vc, gp) AS pred_click, gp - coalesce(vv, gp) AS spread_vs_view FROM g JOIN agg USING (id)""",
)


def _proxy(s, d):
    df, spec = features(s, d)
    return M.proxy_feature(df, ["w1", "hour", "load_forecast"], spec, 100, "gbt", maxIter=5, maxDepth=3)


register(
    "J18_proxy_feature",
    shape(
        "entity ts",
        "",
        "wind_forecast wind_prod_est residual_load_est wind_prod_est_ratio residual_load_est_share "
        "wind_forecast_proxy_gap",
    ),
    _proxy,
)


def _hour_experts(s, d):
    df, spec = features(s, d)
    df = S.hour_regime(df, "block5").withColumn("base", F.lit(50.0))
    table = materialize(M.hour_experts(split(df), X, spec, "base", 60))
    return M.apply_hour_experts(df, table, X, spec, "base", 60, 0.5)


register(
    "J19_hour_experts",
    shape("entity ts hour_regime", "", "target pred", 5),
    _hour_experts,
    f"""WITH RECURSIVE {FEATURES}, r AS (SELECT *, target - 50.0::DOUBLE AS rest, CASE WHEN hour <= 5 THEN 'night_00_05'
        WHEN hour <= 10 THEN 'morning_06_10' WHEN hour <= 16 THEN 'day_11_16' WHEN hour <= 20 THEN 'peak_17_20'
        ELSE 'late_21_23' END AS hour_regime FROM feat),
      train AS (SELECT * FROM r WHERE ts < TIMESTAMP '{CUT}'),
      {ridge_ctes("m", "train", "entity, hour_regime", X, "rest", least=60)}
      SELECT r.entity, ts, r.hour_regime, target, 50.0::DOUBLE + coalesce(0.5::DOUBLE * n / (n + 60.0::DOUBLE) * ({score(X)}), 0) AS pred
      FROM r LEFT JOIN m USING (entity, hour_regime)""",
)
