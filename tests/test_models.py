"""Model fits against brute force in numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import folds as G
from panelkit.operators import model as M
from panelkit.operators import window as Wn
from panelkit.plans.gram import pair_correlations
from panelkit.plans.layout import PanelSpec
from tests.helpers import panel


@pytest.fixture(scope="module")
def data(spark):
    df = S.calendar(panel(spark, 120)).cache()
    return df, PanelSpec().measured(df)


def ridge_numpy(x, y, alpha):
    mean, std = x.mean(0), x.std(0)
    std[std <= 1e-12] = 1.0
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return w / std, y.mean() - (w / std) @ mean


def test_ridge_matches_normal_equations(data):
    df, spec = data
    cols = ["x", "y", "hour"]
    rows = {r["entity"]: r for r in M.grouped_ridge(df, ["entity"], cols, "target", spec, 3.0).collect()}
    pdf = df.select("entity", "target", *cols).toPandas()
    for e, g in pdf.groupby("entity"):
        x = g[cols].fillna(g[cols].median()).to_numpy(dtype=float)
        coefs, intercept = ridge_numpy(x, g["target"].to_numpy(), 3.0)
        np.testing.assert_allclose(rows[e]["coefs"], coefs, rtol=1e-7, atol=1e-9)
        assert rows[e]["intercept"] == pytest.approx(intercept, rel=1e-7)


def test_unknown_entity_takes_fallback(data):
    df, spec = data
    table = M.grouped_ridge(df.filter("entity <> 'c'"), ["entity"], ["x"], "target", spec)
    out = M.predict_ridge(df, table, ["entity"], ["x"], spec, fallback=F.lit(-1.0))
    assert {r["pred"] for r in out.filter("entity = 'c'").collect()} == {-1.0}
    assert out.filter("entity <> 'c' AND pred = -1.0").count() == 0


def test_pair_correlations_match_pandas(data):
    df, _ = data
    cols = ["target", "x", "y", "hour"]
    want = df.select(*cols).toPandas().corr()
    np.testing.assert_allclose(pair_correlations(df.withColumn("hour", F.col("hour").cast("double")), cols), want, atol=1e-9)


def test_corr_prune_and_groups(data):
    df, _ = data
    df = df.withColumns({"a": F.col("y"), "b": F.col("y") * 2 + 1, "c": F.col("x"), "flat": F.lit(3.0)})
    kept, drops = M.corr_prune(df.fillna(0.0, ["c"]), ["a", "b", "c"], 0.9)
    assert kept == ["a", "c"] and drops.count() == 1
    sizes = {r["feature"]: r["group_size"] for r in M.correlation_groups(df, ["a", "b", "c", "flat"], 0.9).collect()}
    assert sizes == {"a": 2, "b": 2, "c": 1, "flat": 1}


def test_walk_forward_never_trains_on_the_future(data):
    df, spec = data
    folds = G.rolling_date_folds(df, spec, 2, 1, 1, 1)
    seen = []

    def fit_predict(train, val):
        seen.append((train.agg(F.max("ts")).first()[0], val.agg(F.min("ts")).first()[0]))
        return val.withColumn("pred", F.lit(0.0))

    oof = M.walk_forward(df.repartition(7), folds, spec, fit_predict)
    assert all(a < b for a, b in seen) and len(seen) == 2
    assert oof.join(df.select("id", F.col("target").alias("t")), "id").filter("t <> target").count() == 0


def test_identity_permutation_changes_nothing(data):
    df, spec = data
    same = M.permute_columns(df, ["x", "y"], spec, 3, identity=True)
    assert same.exceptAll(df).count() == 0 and same.count() == df.count()


@pytest.mark.parametrize("chunk", [250_000, 40])
def test_permutation_moves_values_together(data, chunk):
    df, _ = data
    spec = PanelSpec(chunk_rows=chunk).measured(df)
    moved = M.permute_columns(df, ["x", "y"], spec, 3)
    pairs = lambda d: sorted((str(r.x), r.y) for r in d.select("x", "y").collect())
    assert pairs(moved) == pairs(df)
    changed = moved.join(df.select("id", F.col("y").alias("old")), "id").filter("y <> old").count()
    assert changed > 0.8 * df.count()
    again = M.permute_columns(df.repartition(9), ["x", "y"], spec, 3)
    assert moved.exceptAll(again).count() == 0


def test_importance_finds_the_signal(data):
    df, spec = data
    df = df.withColumn("target", 3 * F.col("y") + F.col("hour"))
    table = M.grouped_ridge(df, ["entity"], ["x", "y", "hour"], "target", spec, 0.1)

    def predict(rows):
        return M.predict_ridge(rows, table, ["entity"], ["x", "y", "hour"], spec)

    rows = M.permutation_importance(df, predict, {"y": ["y"], "x": ["x"]}, spec).collect()
    delta = {r["name"]: r["delta"] for r in rows}
    assert delta["y"] > 10 * abs(delta["x"])


def test_recursion_matches_a_loop(data):
    df, spec = data
    lag_steps, windows, x = (1, 3), (4,), ["y"]
    cut = pd.Timestamp("2024-01-05")
    lagged = Wn.rolling(Wn.lags(df, spec, ["target"], lag_steps), spec, ["target"], windows)
    names = M.history_features(lag_steps, windows)
    table = M.grouped_ridge(lagged, ["entity"], [*x, *names], "target", spec, 1.0).cache()
    before, after = df.filter(F.col("ts") < F.lit(cut)), df.filter(F.col("ts") >= F.lit(cut))
    after = after.withColumn("direct", F.lit(-7.0))
    got = M.recursive_forecast(before, after, table, x, spec, 5, "direct", lag_steps, windows)
    got = {r["id"]: r["pred"] for r in got.collect()}
    assert len(got) == after.count()
    coefs = {r["entity"]: r for r in table.collect()}
    pdf = df.toPandas().sort_values(["ts", "id"])
    for e, g in pdf.groupby("entity"):
        hist = g.loc[g["ts"] < cut, "target"].tolist()
        c = coefs[e]
        for i, row in enumerate(g[g["ts"] >= cut].itertuples()):
            if i >= 5:
                assert got[row.id] == -7.0
                continue
            tail = hist[-4:]
            values = [row.y]
            values += [hist[-k] if len(hist) >= k else None for k in lag_steps]
            values += [np.mean(tail), np.std(tail, ddof=1) if len(tail) > 1 else 0.0] if hist else [None, None]
            filled = [f if v is None else v for v, f in zip(values, c["fills"])]
            pred = c["intercept"] + float(np.dot(c["coefs"], filled))
            assert got[row.id] == pytest.approx(pred, rel=1e-9)
            hist.append(pred)


def test_models_beat_the_mean_on_a_planted_signal(data):
    df, spec = data
    df = df.withColumn("target", 2 * F.col("hour") + F.when(F.col("x") > 5, 30.0).otherwise(0.0))
    mean_error = df.agg(F.stddev_pop("target")).first()[0]
    for family, params in (("gbt", {"maxIter": 5}), ("lasso", {})):
        model = M.fit_global(df, ["x", "hour"], "target", family, spec, ["entity"], **params)
        out = model.predict(df)
        err = out.agg(F.sqrt(F.avg((F.col("pred") - F.col("target")) ** 2))).first()[0]
        assert err < 0.7 * mean_error, family


def test_stack_weights(data):
    df, _ = data
    df = df.withColumns({"m1": F.col("target") + 1.0, "m2": F.lit(0.0) - F.col("target")})
    rows = {r["model"]: r["weight"] for r in M.nonneg_stack(df, ["m1", "m2"], 0.1).collect()}
    assert rows["m1"] == pytest.approx(1.0) and rows["m2"] == 0.0


def test_importance_does_not_depend_on_sizes(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, float(i % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, id bigint, target double")
    df = df.withColumn("x", F.col("target"))

    def predict(d):
        return d.withColumn("pred", F.col("x"))

    specs = [PanelSpec(), PanelSpec(chunk_rows=40).measured(df), PanelSpec().measured(df)]
    deltas = {
        round(M.permutation_importance(df, predict, {"x": ["x"]}, s).first()["delta"], 9) for s in specs
    }
    assert len(deltas) == 1 and deltas.pop() > 30


def test_ridge_takes_nan_and_infinity_as_missing(spark):
    odd = [float("nan"), float("inf"), None]
    for value in odd:
        rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, 2.0 * i, float(i) if i != 7 else value) for i in range(40)]
        df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, id bigint, target double, x double")
        spec = PanelSpec().measured(df)
        got = M.grouped_ridge(df, ["entity"], ["x"], "target", spec, alpha=0.1).first()
        assert abs(got["coefs"][0] - 2.0) < 0.1 and abs(got["fills"][0] - 20.0) < 1.0


def test_proxy_feature_keeps_its_columns_with_few_rows(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0, 1.0, 3.0)], "id bigint, wind_forecast double, load_forecast double, solar_forecast double, w double")
    out = M.proxy_feature(df, ["w"], PanelSpec())
    assert {"wind_prod_est", "residual_load_est"} <= set(out.columns) and out.first()["wind_prod_est"] is None


def test_ridge_importance_equals_the_general_way(data):
    df, spec = data
    table = M.grouped_ridge(df, ["entity"], ["x", "y", "hour"], "target", spec, 0.1)

    def predict(rows):
        return M.predict_ridge(rows, table, ["entity"], ["x", "y", "hour"], spec)

    groups = {"y": ["y"], "both": ["hour", "x"], "other": ["entity"], "text and number": ["ts", "y"]}
    a = {r.name: r for r in M.permutation_importance(df, predict, {k: v for k, v in groups.items() if k != "other"}, spec).collect()}
    b = {r.name: r for r in M.ridge_importance(df, table, ["entity"], ["x", "y", "hour"], groups, spec).collect()}
    for name, r in a.items():
        assert b[name].rmse_permuted == pytest.approx(r.rmse_permuted, rel=1e-9) and r.n_val_rows == df.count()
    assert b["other"].delta == pytest.approx(0.0, abs=1e-9)
    assert M.permutation_importance(df.filter("false"), predict, {"y": ["y"]}, spec).count() == 0


def test_permuted_rows_are_shuffled_once_per_row(spark, data):
    """What is moved is each group's own columns, however many others the table has."""
    df, spec = data
    wide = df.withColumns({f"more{i}": F.lit(float(i)) for i in range(30)})
    both, n = M._moved(wide, {"y": ["y"], "x": ["x"]}, spec, 1, 1)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "Aggregate [__to" in line)
    assert n == wide.count() and "more" not in sent and both.count() == n
