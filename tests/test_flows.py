"""Composed forecasts against their parts."""

import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import flows as L
from panelkit.plans.layout import PanelSpec
from tests.helpers import panel


@pytest.fixture(scope="module")
def data(spark):
    df = S.calendar(panel(spark, 200)).withColumn("target", F.col("hour") * 3.0 + F.coalesce("x", F.lit(0.0)))
    df = df.withColumn("gone", F.col("x").isNull().cast("int")).cache()
    return df, PanelSpec().measured(df)


def test_spike_fallback_is_its_parts(data):
    df, spec = data
    flow = L.fit_spike_fallback(df, ["x", "hour"], ["hour"], "gone", spec, ["entity"], "ridge", 2.0, 0.9, 0.9, 50)
    rows = flow.predict(df).select("*").collect()
    full = {r.id: r.p for r in flow.full.predict(df, "p").collect()}
    fallback = {r.id: r.p for r in flow.fallback.predict(df, "p").collect()}
    assert any(r.gone for r in rows) and flow.cap > 0
    for r in rows:
        base = fallback[r.id] if r.gone else full[r.id]
        step = min(max(r.uplift, -flow.cap), flow.cap)
        assert r.base == pytest.approx(base) and r.pred == pytest.approx(base + r.prob**2 * step)


def test_family_ensemble_is_the_weighted_sum(data):
    df, spec = data
    flow = L.fit_family_ensemble(
        df.filter("entity <> 'c'"), ["x", "hour"], {"ridge": {}, "forest": {"numTrees": 3}}, spec, ["entity"],
        {"ridge": 3.0, "forest": 1.0}, {"forest": {"trees": 2, "depth": 2}}, ["a", "b", "c"], 48,
    )
    assert flow.weights == {"ridge": 0.75, "forest": 0.25}
    for r in flow.predict(df).collect():
        assert r.pred == pytest.approx(0.75 * r.pred_ridge + 0.25 * r.pred_forest)
        if r.entity == "c":  # no model of its own
            assert r.pred == pytest.approx(r.global_pred)
    with pytest.raises(ValueError):
        L.fit_family_ensemble(df, ["x"], {"ridge": {}}, spec, weights={"other": 1.0})


def test_weights_follow_errors(spark):
    rows = [(i, float(i), float(i) + 1.0, float(i) + 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, target double, a double, b double")
    oof = {c: df.select("id", "target", F.col(c).alias("pred"), F.lit(1).alias("fold")) for c in "ab"}
    oof["b"] = oof["b"].unionByName(oof["b"].withColumns({"fold": F.lit(0), "pred": F.lit(1e6)}))  # the latest fold counts
    assert L.oof_weights(oof, PanelSpec()) == pytest.approx({"a": 0.8, "b": 0.2})


def test_calibration_on_a_holdout(data):
    df, spec = data
    late = F.col("ts") >= F.lit("2024-01-07").cast("timestamp_ntz")
    moved = df.withColumn("target", F.when(late, F.col("target") + 100.0).otherwise(F.col("target")))
    seen = []

    def fit(train):
        seen.append(train.count())
        return lambda rows: rows.withColumn("pred", F.col("hour") * 3.0)

    flow = L.fit_calibrated(moved, fit, spec, 2, min_rows=1, low=0.0, high=1.0)
    assert seen[0] < seen[1] == moved.count() and flow.errors["train"] == seen[0]
    bias = {(r.entity, r.hour): r.bias for r in flow.bias.collect()}
    assert all(b > 50 for b in bias.values())
    for r in flow.predict(moved).collect():
        want = r.hour * 3.0 + bias.get((r.entity, r.hour), 0.0)
        assert r.was_clipped or r.pred == pytest.approx(want)
    with pytest.raises(ValueError):
        L.fit_calibrated(moved, fit, spec, 400)


def test_final_ensemble_checks_ids(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id long, target double")
    b = spark.createDataFrame([(1, 6.0), (2, -20.0)], "id long, target double")
    ids = a.select("id")
    got = L.final_ensemble({"a": a, "b": b}, {"a": 3.0, "b": 1.0}, ids, lower=0.0)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3.0), (2, 0.0)]
    for bad in (lambda: L.final_ensemble({"a": a, "b": b.limit(1)}, {"a": 1.0, "b": 1.0}, ids),
                lambda: L.final_ensemble({"a": a}, {"b": 1.0}, ids),
                lambda: L.final_ensemble({"a": a}, {"a": 1.0}, spark.range(1, 4))):
        with pytest.raises(ValueError):
            bad()
