"""Queries for composed forecasts. Those of tree models have no SQL and are checked by their parts in the tests."""

from pyspark.sql import functions as F

from catalog.common import register, shape
from catalog.linear_sql import ridge_ctes, score
from catalog.model import FEATURES, TEST, X, features, split, test_part
from catalog.profile import CUT
from catalog.window import EVENT_TYPES, hourly
from panelkit.operators import flows as L
from panelkit.operators import folds as G
from panelkit.operators import model as M
from panelkit.operators import onepass as O
from panelkit.operators import window as Wn
from panelkit.sources.io import materialize

PRED = shape("entity ts", "id", "pred", 5)


def _spike_fallback(s, d):
    """Weather columns are missing in some rows; the fallback does without them."""
    df, spec = features(s, d)
    df = df.withColumn("gone", F.col("w2").isNull().cast("int"))
    flow = L.fit_spike_fallback(
        split(df), [*X, "w1", "w2"], X, "gone", spec, ["entity"], "gbt", 1.5, 0.9, 0.9, 100, maxIter=5, maxDepth=3
    )
    return flow.predict(test_part(df))


register("flow_spike_fallback", PRED, _spike_fallback)


def _family_ensemble(s, d):
    df, spec = features(s, d)
    flow = L.fit_family_ensemble(
        split(df), X, {"ridge": {}, "forest": {"numTrees": 10, "maxDepth": 4}}, spec, ["entity"],
        {"ridge": 2.0, "forest": 1.0}, {"forest": {"trees": 5, "depth": 3}}, EVENT_TYPES, 48,
    )
    return flow.predict(test_part(df))


register("flow_family_ensemble", PRED, _family_ensemble)

TWO = ["load_forecast", "hour"]


def _ridge_fit(x, spec):
    def fit(train):
        table = materialize(M.grouped_ridge(train, [spec.entity], x, spec.target, spec))
        return lambda rows: M.predict_ridge(rows, table, [spec.entity], x, spec)

    return fit


def _calibrated(s, d):
    df, spec = hourly(s, d)
    flow = L.fit_calibrated(split(df), _ridge_fit(TWO, spec), spec, 5, min_rows=4, low=0.05, high=0.9)
    return flow.predict(test_part(df))


def _q(p: float) -> str:
    return f"quantile_cont(target, {p}::DOUBLE)"


register(
    "flow_holdout_calibration",
    shape("entity ts", "id was_clipped", "pred", 5),
    _calibrated,
    f"""WITH RECURSIVE {FEATURES}, known AS (SELECT * FROM feat WHERE ts < TIMESTAMP '{CUT}'),
      cut AS (SELECT max(ts) - INTERVAL 5 DAY AS t FROM known),
      train AS (SELECT known.* FROM known, cut WHERE ts < t), held AS (SELECT known.* FROM known, cut WHERE ts >= t),
      {ridge_ctes("a", "train", "entity", TWO, "target")}, {ridge_ctes("b", "known", "entity", TWO, "target")},
      bias AS (SELECT entity, hour, avg(target - ({score(TWO)})) AS bias FROM held JOIN a USING (entity) GROUP BY ALL HAVING count(*) >= 4),
      cell AS (SELECT entity, hour, {_q(0.05)} AS lo, {_q(0.9)} AS hi FROM known GROUP BY ALL),
      own AS (SELECT entity, {_q(0.05)} AS lo, {_q(0.9)} AS hi FROM known GROUP BY ALL),
      p AS (SELECT f.entity, ts, id, f.hour, {score(["f.load_forecast", "f.hour"], "b")} + coalesce(bias, 0) AS p FROM feat f JOIN b USING (entity)
        LEFT JOIN bias ON bias.entity = f.entity AND bias.hour = f.hour WHERE {TEST}),
      r AS (SELECT p.*, coalesce(cell.lo, own.lo) AS lo, coalesce(cell.hi, own.hi) AS hi FROM p
        LEFT JOIN cell ON cell.entity = p.entity AND cell.hour = p.hour JOIN own ON own.entity = p.entity)
      SELECT entity, ts, id, least(greatest(p, lo), hi) AS pred, (p < lo OR p > hi)::INT AS was_clipped FROM r""",
)

LAG = ["load_forecast_lag_24"]


def _weighted(s, d):
    """Two ridges weighted by their out-of-fold errors, for the rows of the test part."""
    df, spec = hourly(s, d)
    df = materialize(Wn.lags(df, spec, ["load_forecast"], [24]))
    folds = G.rolling_date_folds(df, spec, 3, 4, 4, 10)
    both = {"now": TWO, "lag": LAG}
    weights = L.oof_weights({name: O.walk_forward_ridge(df, folds, spec, x) for name, x in both.items()}, spec)
    test = test_part(df)
    preds = {
        name: _ridge_fit(x, spec)(split(df))(test).select("id", F.col("pred").alias("target")) for name, x in both.items()
    }
    return L.final_ensemble(preds, weights, test.select("id"))


register(
    "flow_oof_weighted_ensemble",
    shape("", "id", "target", 5),
    _weighted,
    f"""WITH RECURSIVE {FEATURES},
      f AS (SELECT 3 - i AS fold, ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i) DAY)::TIMESTAMP AS ve,
        ((SELECT max(ts)::DATE FROM panel) - INTERVAL (4 * i + 4) DAY)::TIMESTAMP AS vs FROM range(3) AS r(i)),
      early AS (SELECT feat.*, fold FROM feat JOIN f ON ts < vs), known AS (SELECT * FROM feat WHERE ts < TIMESTAMP '{CUT}'),
      {ridge_ctes("a", "early", "entity, fold", TWO, "target")}, {ridge_ctes("b", "early", "entity, fold", LAG, "target")},
      {ridge_ctes("c", "known", "entity", TWO, "target")}, {ridge_ctes("e", "known", "entity", LAG, "target")},
      val AS (SELECT feat.*, fold FROM feat JOIN f ON ts >= vs AND ts < ve),
      w AS (SELECT 1 / avg((({score(TWO, "a")}) - target) ** 2) AS wa, 1 / avg((({score(LAG, "b")}) - target) ** 2) AS wb
        FROM val v JOIN a ON a.entity = v.entity AND a.fold = v.fold JOIN b ON b.entity = v.entity AND b.fold = v.fold)
      SELECT id, (wa * ({score(TWO, "c")}) + wb * ({score(LAG, "e")})) / (wa + wb) AS target
      FROM feat v JOIN c ON c.entity = v.entity JOIN e ON e.entity = v.entity, w WHERE {TEST}""",
)
