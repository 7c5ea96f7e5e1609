"""Grouped trees and mixed recursion against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import model as M
from panelkit.operators import recursion as R
from panelkit.operators import window as Wn
from panelkit.plans import trees as T
from panelkit.plans.layout import PanelSpec
from tests.helpers import panel


@pytest.fixture(scope="module")
def data(spark):
    df = S.calendar(panel(spark, 200)).withColumn(
        "target", F.col("hour") * 3.0 + F.coalesce("x", F.lit(5.0)) * F.col("hour") / 4.0 + F.log("y")
    )
    df = df.cache()
    return df, PanelSpec().measured(df)


X = ["x", "y", "hour"]


def plain_gbt(x, y, bins, depth, trees, rate, min_rows=1):
    """Boosting by exhaustive loops over features and edges; returns predictions of the rows."""
    mid = np.nanmedian(x, 0)
    edges = [np.unique(np.nanpercentile(x[:, i], [100 * j / bins for j in range(1, bins)])) for i in range(x.shape[1])]
    x = np.where(np.isnan(x), mid, x)
    pred = np.full(len(y), y.mean())
    for _ in range(trees):
        rest, add = y - pred, np.zeros(len(y))

        def split(rows, level):
            add[rows] = rest[rows].mean()
            if level == depth:
                return
            best, gain = None, 0.0
            total = rest[rows].sum() ** 2 / len(rows)
            for f in range(x.shape[1]):
                for e in edges[f]:
                    left = rows[x[rows, f] <= e]
                    right = rows[x[rows, f] > e]
                    if len(left) >= min_rows and len(right) >= min_rows:
                        g = rest[left].sum() ** 2 / len(left) + rest[right].sum() ** 2 / len(right) - total
                        if g > gain + 1e-9 * abs(g):
                            best, gain = (left, right), g
            if best and gain > 1e-9:
                for part in best:
                    split(part, level + 1)

        split(np.arange(len(y)), 0)
        pred = pred + rate * add
    return pred


@pytest.mark.parametrize("chunk", [250_000, 40])
def test_grouped_boosting_matches_a_loop(spark, data, chunk):
    df, _ = data
    spec = PanelSpec(chunk_rows=chunk).measured(df)
    model = T.grow(df.repartition(5), "entity", X, "target", spec, trees=4, depth=3, bins=8, rate=0.3, min_rows=3)
    got = df.withColumn("pred", model.column(spark, F.col("entity"))).toPandas()
    for _, g in got.groupby("entity"):
        want = plain_gbt(g[X].to_numpy(dtype=float), g["target"].to_numpy(), 8, 3, 4, 0.3, 3)
        np.testing.assert_allclose(g["pred"], want, rtol=1e-9)


def test_jobs_do_not_grow_with_groups(spark, data):
    df, spec = data
    counts = []
    for frame in (df.filter("entity = 'a'"), df):
        spark.sparkContext.setJobGroup(f"grow{len(counts)}", "")
        T.grow(frame, "entity", X, "target", spec, trees=2, depth=2, bins=8)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grow{len(counts)}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 2  # adaptive execution may cut stages otherwise


@pytest.mark.parametrize("family", ["gbt", "forest"])
def test_local_trees_beat_the_mean(data, family):
    df, spec = data
    rows = df.withColumn("global_pred", F.lit(30.0))
    train = rows.filter("id % 3 <> 0 AND entity <> 'c'")
    local = M.fit_local(train, X, "target", spec, family, trees=20, depth=4, bins=16)
    out = local.predict(rows).toPandas()
    held = out[(out["id"] % 3 == 0) & (out["entity"] != "c")]
    mean = held.groupby("entity")["target"].transform("mean")
    assert ((held["pred"] - held["target"]) ** 2).mean() < 0.4 * ((mean - held["target"]) ** 2).mean()
    assert set(out[out["entity"] == "c"]["pred"]) == {30.0}


def test_trees_of_odd_rows(spark):
    rows = [("a", 1, 1.0, None, 2.0), ("a", 2, float("nan"), 1.0, None), ("a", 3, 2.0, float("inf"), float("nan")),
            (None, 4, 5.0, 1.0, 7.0), ("b", 5, None, None, None), ("a", 6, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "entity string, id long, x double, y double, target double").withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))
    spec = PanelSpec().measured(df)
    model = T.grow(df, "entity", ["x", "y"], "target", spec, trees=2, depth=2, bins=4)
    got = {r.id: r.p for r in df.withColumn("p", model.column(spark, F.col("entity"))).collect()}
    assert got[5] is None and got[4] == 7.0 and all(2.0 <= got[i] <= 4.0 for i in (1, 2, 3, 6))
    assert T.grow(df.filter("false"), "entity", ["x", "y"], "target", spec).models == {}
    with pytest.raises(ValueError):
        T.grow(df, "entity", ["x"], "target", spec, trees=10**7)


@pytest.mark.parametrize("family,params", [("gbt", {"maxIter": 4, "maxDepth": 3}), ("forest", {"numTrees": 5}), ("ridge", {}), ("lasso", {})])
def test_flat_models_score_like_pyspark_ml(data, family, params):
    df, spec = data
    model = M.fit_global(df, X, "target", family, spec, ["entity"], **params)
    want = model.predict(df).toPandas()
    scorer = R._scorer(model, "normal")
    numbers = {c: want[c].to_numpy(dtype=float) for c in X}
    got = scorer.score(numbers, {"entity": list(want["entity"])}, want["entity"].to_numpy(), {})
    np.testing.assert_allclose(got, want["pred"], rtol=1e-9)


LAGS, ROLLS = (1, 2, 5), (3, 6)


def step_rows(past, horizon, s):
    """The rows of step s with history features from plain lists."""
    rows = []
    for e, some in horizon.items():
        if s < len(some):
            h = past[e]
            row = dict(some[s], entity=e)
            for lag in LAGS:
                row[f"target_lag_{lag}"] = h[-lag] if len(h) >= lag else None
            for n in ROLLS:
                row[f"target_roll_mean_{n}"] = float(np.mean(h[-n:])) if h else None
                row[f"target_roll_std_{n}"] = (float(np.std(h[-n:], ddof=1)) if len(h[-n:]) > 1 else 0.0) if h else None
            rows.append(row)
    return rows


@pytest.mark.parametrize("kind", ["trees", "local", "linear"])
def test_mixture_matches_a_loop(spark, data, kind):
    df, spec = data
    both = Wn.rolling(Wn.lags(df, spec, ["target"], LAGS), spec, ["target"], ROLLS, ["mean", "std"])
    cut = dt.datetime(2024, 1, 7)
    train, horizon = both.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut).withColumn("direct", F.col("hour") * 1.0)
    hist_x = M.history_features(LAGS, ROLLS)
    x = ["hour", "x", *hist_x]
    labelled = M.tail_labels(train, "upper", spec, 0.8)
    if kind == "trees":
        models = R.Mixture(
            M.fit_global(train, x, "target", "gbt", spec, ["entity"], maxIter=3, maxDepth=3),
            M.fit_global(train, x, "target", "forest", spec, numTrees=4, maxDepth=3),
            M.fit_gate(labelled, x, "tail_label", spec, "gbt", maxIter=3, maxDepth=3),
        )
    elif kind == "local":
        models = R.Mixture(
            T.grow(train, "entity", x, "target", spec, trees=4, depth=3, bins=8),
            R.LinearModels(M.grouped_ridge(train, ["entity"], x, "target", spec), x),
            M.fit_gate(labelled, x, "tail_label", spec),
        )
    else:
        models = R.Mixture(
            R.LinearModels(M.grouped_ridge(train, ["entity"], x, "target", spec), x),
            R.LinearModels(M.grouped_ridge(train, ["entity"], ["target_lag_2"], "target", spec), ["target_lag_2"]),
        )
    steps = 4
    got = R.recursive_mixture(train, horizon, models, spec, steps, "direct", "direct", 5, LAGS, ROLLS).toPandas()
    assert sorted(got["id"]) == sorted(r.id for r in horizon.select("id").collect())
    assert dict(got.groupby("part").size())["near"] == 3 * steps and (got.groupby(["entity", "part"]).size()[:, "mid"] <= 5).all()

    past = {e: list(g.sort_values(["ts", "id"])["target"]) for e, g in train.select("entity", "ts", "id", "target").toPandas().groupby("entity")}
    pdf = horizon.select("entity", "ts", "id", "hour", "x").toPandas().sort_values(["ts", "id"])
    lists = {e: [{"id": int(r.id), "ts": r.ts.to_pydatetime(), "hour": int(r.hour), "x": None if pd.isna(r.x) else float(r.x)} for r in g.itertuples()] for e, g in pdf.groupby("entity")}
    schema = "entity string, id long, ts timestamp_ntz, hour int, x double, " + ", ".join(f"{c} double" for c in hist_x)
    want = {}

    def ask(model, rows, out):
        if isinstance(model, R.LinearModels):
            return M.predict_ridge(rows, model.table, ["entity"], model.x, spec, out)
        if isinstance(model, T.GroupTrees):
            return rows.withColumn(out, model.column(spark, F.col("entity")))
        if isinstance(model, float):
            return rows.withColumn(out, F.lit(model))
        return model.predict(rows, out)

    for s in range(steps):
        rows = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in step_rows(past, lists, s)], schema)
        scored = ask(models.gate, ask(models.spike, ask(models.normal, rows, "n"), "s"), "g")
        for r in scored.collect():
            want[r.id] = (1 - r.g) * r.n + r.g * r.s
            past[r.entity].append(want[r.id])
    near = got[got["part"] == "near"].set_index("id")["pred"]
    assert set(near.index) == set(want)
    for i, v in want.items():
        assert near[i] == pytest.approx(v, rel=1e-9)


def test_mixture_without_history_or_model(spark, data):
    df, spec = data
    models = R.Mixture(R.LinearModels(M.grouped_ridge(df.filter("entity = 'a'"), ["entity"], ["hour"], "target", spec), ["hour"]))
    got = R.recursive_mixture(df.filter("false"), df, models, spec, 3, lag_steps=(1,), windows=()).toPandas()
    assert got[got["entity"] == "a"]["pred"].notna().all() and got[got["entity"] != "a"]["pred"].isna().all()
    assert len(got) == 9
