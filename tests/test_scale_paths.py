"""The ways taken for large groups give the same rows as the plain ones.

A spec with a tiny ``chunk_rows`` cannot prove any group small, so every operator takes the
spread-out way; the measured default spec takes the plain one."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import blend, corr, folds, metrics, model, profile, select, window
from panelkit.plans import gram, layout, ranks
from panelkit.plans.layout import PanelSpec
from tests.helpers import panel, same

KEY = "id"


@pytest.fixture(scope="module")
def data(spark):
    df = panel(spark).cache()
    small = PanelSpec().measured(df, "ts")
    assert small.bounded(["entity"]) and small.bounded(["ts"]) and small.bounded([])
    return df, small


@pytest.fixture(scope="module", params=[20])
def spread(request, data):
    df, _ = data
    spec = PanelSpec(chunk_rows=request.param).measured(df)
    assert not spec.bounded(["entity"]) and not spec.bounded([])
    return spec


@pytest.fixture(scope="module")
def unmeasured():
    return PanelSpec(chunk_rows=25)


def test_bucket_width_follows_density(data):
    df, _ = data
    assert PanelSpec(chunk_rows=8).measured(df).bucket_seconds <= 3600
    assert PanelSpec(chunk_rows=200).measured(df).bucket_seconds > 3600


def test_chunks_are_bounded(data):
    df, _ = data
    spec = PanelSpec(chunk_rows=20).measured(df)
    f = layout.row_frames(df, spec, 5)
    sizes = f.df.groupBy("entity", "__chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= 20 + 5 + 2 * 20
    assert f.done(f.df).count() == df.count()


@pytest.mark.parametrize("k", [24])
def test_lags(data, spread, k):
    df, small = data
    same(window.lags(df, spread, ["x", "y"], [1, k]), window.lags(df, small, ["x", "y"], [1, k]), KEY)


def test_lags_unmeasured(data, unmeasured):
    df, small = data
    same(window.lags(df, unmeasured, ["y"], [3]), window.lags(df, small, ["y"], [3]), KEY)


def test_rolling(data, spread):
    df, small = data
    fns = ["mean", "std", "min", "max"]
    a = window.rolling(df, spread, ["x", "target"], [6, 24], fns)
    same(a, window.rolling(df, small, ["x", "target"], [6, 24], fns), KEY, 1e-8)


def test_other_frames(data, spread):
    df, small = data
    for op in (
        lambda s: window.diffs(df, s, ["y"], [1, 6], absolute=True),
        lambda s: window.anomaly(df, s, ["target"]),
        lambda s: window.transition(df, s, "target"),
        lambda s: window.exog_block(df, s, ["x"], ["a"], [1, 2, 6], [6, 24]),
    ):
        same(op(spread), op(small), KEY, 1e-7)


def test_long_frames(data, spread):
    df, small = data
    for op in (
        lambda s: window.volatility(df, s, ["target"], 30, 60),
        lambda s: window.slow_state(df, s, "target", (24, 180)),
        lambda s: window.residual_rolling(df, s, "target"),
    ):
        same(op(spread), op(small), KEY, 1e-6)


def test_blocks_equal_direct_frames(data, spread, monkeypatch):
    df, small = data
    every, need = ("mean", "std", "min", "max"), {"min": 3, "max": 20}
    frames = [11, 16, 17, 24, 31, 50]
    direct = window.rolling(df, small, ["x", "target"], frames, every, need)
    pairs = {shift: window.rolling_pair_corr(df, small, [("a", "b"), ("a", "c")], 40, 5, shift) for shift in (True, False)}
    monkeypatch.setattr(window, "LONG_FRAME", 10)
    for spec in (small, spread):
        same(window.rolling(df, spec, ["x", "target"], frames, every, need), direct, KEY, 1e-7)
        for shift, want in pairs.items():
            same(window.rolling_pair_corr(df, spec, [("a", "b"), ("a", "c")], 40, 5, shift), want, ["a", "b", "ts"], 1e-7)


def test_long_min_and_max_and_constant_stretches(spark):
    """A spike leaves a frame without a trace, and a constant side has no correlation."""
    rows = [(e, i, float(i % 7 if e == "a" else 5.0) + (1e9 if i == 3 else 0.0)) for e in "ab" for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, id long, target double")
    df = df.withColumn("ts", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))))
    spec = PanelSpec().measured(df)
    out = window.rolling(df, spec, ["target"], [720], ["min", "max", "std"]).filter("id = 800").collect()
    got = {r.entity: (r.target_roll_min_720, r.target_roll_max_720, r.target_roll_std_720) for r in out}
    assert got["b"] == (5.0, 5.0, 0.0) and got["a"][:2] == (0.0, 6.0) and abs(got["a"][2] - 2.0) < 0.01
    corr = {r.ts: r["corr"] for r in window.rolling_pair_corr(df, spec, [("a", "b")], 720, 5).collect()}
    late = [corr[t] for t in sorted(corr)]
    assert late[700] == pytest.approx(1.0) and late[800] is None and len(late) == 900


def test_expanding(data, spread):
    df, small = data
    df = df.withColumn("hour", F.hour("ts"))
    for keys in (["entity"], ["entity", "hour"]):
        a = window.expanding_prev(df, spread, keys, "target", "p")
        same(a, window.expanding_prev(df, small, keys, "target", "p"), KEY, 1e-8)


def test_cross_section(data, spread):
    df, small = data
    for op in (window.cross_section, window.robust_cross, window.extreme_flags, window.pct_rank_avg):
        same(op(df, spread, ["x", "y"]), op(df, small, ["x", "y"]), KEY, 1e-8)


def test_quantiles(data, spread):
    df, small = data
    want = {
        "a": ("x", 0.5),
        "b": ("y", 0.9),
        "c": (-F.col("y"), 0.01),
        "d": (F.when(F.col("entity") != "b", F.col("target")), 0.37),
        "e": ("y", 1.0),
        "f": ("y", 0.0),
    }
    for keys in (["entity"], []):
        same(ranks.quantiles(df, keys, want, spread), ranks.quantiles(df, keys, want, small), keys)


def test_quantiles_of_narrow_and_extreme_values(spark):
    """Values inside one coarse bucket, huge and tiny values, signs and zeros."""
    rng = np.random.default_rng(1)
    vals = [1000 + 1e-4 * v for v in rng.random(300)] + [1e300, -1e300, 1e-300, 0.0, -0.0, -5.0]
    df = spark.createDataFrame([("k", float(v)) for v in vals], "entity string, v double")
    want = {f"q{i}": ("v", i / 20) for i in range(21)}
    row = ranks.quantiles(df, ["entity"], want, PanelSpec(chunk_rows=5)).first()
    for i in range(1, 20):
        assert row[f"q{i}"] == pytest.approx(float(np.quantile(vals, i / 20)), rel=1e-12)
    assert row["q0"] == -1e300 and row["q20"] == 1e300


def test_quantiles_read_only_the_buckets_of_wanted_places(spark, monkeypatch):
    """All rows are counted in buckets; values are counted one by one only in the buckets asked for."""
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], i % 3, float(v)) for i, v in enumerate(rng.uniform(1, 9, 4000))]
    rows += [("c", 0, None), ("c", 0, float("nan")), (None, 1, 3.0), (None, 1, -2.0)]
    df = spark.createDataFrame(rows, "entity string, k int, v double")
    stored = []
    whole = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda d: stored.append(whole(d)) or stored[-1])
    want = {"m": ("v", 0.5), "p": ("v", 0.9), "n": (-F.col("v"), 0.9)}
    for keys in (["entity", "k"], ["entity"], []):
        stored.clear()
        got = ranks.quantiles(df, keys, want, PanelSpec(chunk_rows=1))
        # As many rows as counts: the whole of the buckets, then a small part of the 8,000 values.
        assert max(d.count() for d in stored) < 2500
        everything = PanelSpec(bounds={(): layout.GroupBound(1, len(rows), len(rows))})
        same(got, ranks.quantiles(df, keys, want, everything), keys)


def test_labels_of_labelled_frames_stay_small_plans(data, spark, sf, spread, tmp_path):
    """Each label, and the weights, read fitted tables, not the labelled frame once more."""
    df, small = data
    path = str(tmp_path / "panel")
    df.withColumn("hour", F.hour("ts")).write.parquet(path)
    for spec in (spread, small):
        rows = spark.read.parquet(path)
        for i, mode in enumerate(("upper", "two_sided", "abs", "upper")):
            rows = model.tail_labels(rows, mode, spec, 0.9, 0.1, by_hour=i == 3, hour_min_rows=2, out=f"l{i}")
        rows = model.tail_weights(rows, spec)
        assert sum(path in f for f in rows.inputFiles()) and rows.count() == df.count()
        plan = rows._jdf.queryExecution().analyzed().toString()
        assert plan.count("target#") < 400 and plan.count("Relation") <= 8


def test_weight_below_matches_sorting(data):
    df, _ = data
    d = df.groupBy("entity", "y").agg(F.count("*").alias("n"))
    got = ranks.weight_below(d, ["entity"], "y", "n", PanelSpec(chunk_rows=3))
    for r in got.collect():
        want = df.filter((F.col("entity") == r["entity"]) & (F.col("y") < r["y"]))
        if hash(r["y"]) % 9 == 0:
            assert want.count() == r["below"]
    same(got, ranks.weight_below(d, ["entity"], "y", "n", PanelSpec().measured(df)), ["entity", "y"])


def test_fitted_statistics(data, spread):
    df, small = data
    df = profile.join_table(df, df.groupBy("entity").agg(F.lit(1).alias("one")), ["entity"], small)
    df = df.withColumn("hour", F.hour("ts")).withColumn("dow", F.weekday("ts"))
    train = df.filter("id % 3 > 0 AND entity <> 'c'")
    for op in (
        lambda s: profile.empirical_pctl(train, df, "y", s),
        lambda s: profile.quantile_bins(train, df, "x", 5, s),
        lambda s: profile.quantile_regimes(train, df, "y", s),
        lambda s: profile.impute(train, df, ["x"], [], s),
        lambda s: profile.winsorize(df, profile.winsor_bounds(train, s, 0.1, 0.9, 5), s, "target", "w"),
        lambda s: blend.guardrail_apply(df, blend.guardrail_fit(train, s, 0.1, 0.8), s, "y"),
        lambda s: model.tail_labels(df, "two_sided", s, 0.9, 0.1, True, 6),
    ):
        same(op(spread), op(small), KEY, 1e-9)


def test_metrics(data, spread):
    df, small = data
    df = df.withColumn("pred", F.col("y"))
    same(metrics.error_metrics(df, spread, "entity"), metrics.error_metrics(df, small, "entity"), "entity")
    same(metrics.error_metrics(df, spread), metrics.error_metrics(df, small), [])
    same(
        metrics.compare_predictions(df, "target", "y", spread),
        metrics.compare_predictions(df, "target", "y", small),
        [],
    )


def test_pair_correlations(data, spread):
    df, small = data
    pairs = [("a", "b"), ("a", "c")]
    for shift in (True, False):
        a = window.rolling_pair_corr(df, spread, pairs, 40, 5, shift)
        b = window.rolling_pair_corr(df, small, pairs, 40, 5, shift)
        same(a, b, ["a", "b", "ts"], 1e-7)
    names = ["a", "b", "c"]
    for method in ("pearson", "spearman"):
        same(
            corr.corr_matrix(df, spread, names, method),
            corr.corr_matrix(df, small, names, method),
            ["a", "b"],
        )
    same(
        corr.lead_lag(df, spread, names, "a", range(-5, 6)),
        corr.lead_lag(df, small, names, "a", range(-5, 6)),
        ["a", "b", "lag"],
    )


def test_timestamp_folds(data, spread):
    df, small = data
    same(folds.timestamp_folds(df, spread, 4, 3, 20), folds.timestamp_folds(df, small, 4, 3, 20), "fold")


def test_sampling_is_deterministic(data):
    df, spec = data
    one = {r["id"] for r in select.sample_rows(df, 15, spec, ["entity"], 5).collect()}
    two = {r["id"] for r in select.sample_rows(df.repartition(13), 15, spec, ["entity"], 5).collect()}
    other = {r["id"] for r in select.sample_rows(df, 15, spec, ["entity"], 6).collect()}
    assert one == two != other
    assert len(one) == 45


def test_gram_wide_equals_narrow(data, monkeypatch):
    df, _ = data
    df = df.fillna(0.0, ["x"]).withColumn("z", F.col("y") * 0.5 + F.col("x"))
    cols = ["target", "x", "y", "z"]
    for by in (["entity"], []):
        narrow = {tuple(r[:-1]): r["gram"] for r in gram.gram(df, by, cols).collect()}
        monkeypatch.setattr(gram, "NARROW", 2)
        for held in (4_000_000, 1):
            monkeypatch.setattr(gram, "HELD_VALUES", held)
            wide = {tuple(r[:-1]): r["gram"] for r in gram.gram(df.repartition(5), by, cols).collect()}
            assert narrow.keys() == wide.keys()
            for k in narrow:
                np.testing.assert_allclose(narrow[k], wide[k], rtol=1e-9)
        monkeypatch.undo()


def test_edge_rows(data, spread):
    df, small = data
    for newest in (True, False):
        same(
            model.edge_rows(df, replace(spread), 10, newest),
            model.edge_rows(df, small, 10, newest),
            KEY,
        )


def test_ridge(data, spread):
    df, small = data
    for by in (["entity"], []):
        a = model.predict_ridge(
            df, model.grouped_ridge(df, by, ["x", "y"], "target", spread), by, ["x", "y"], spread
        )
        b = model.predict_ridge(
            df, model.grouped_ridge(df, by, ["x", "y"], "target", small), by, ["x", "y"], small
        )
        same(a, b, KEY, 1e-7)


def test_nan_and_infinity_are_missing_on_both_routes(data):
    odd = F.when(F.col("id") % 17 == 3, float("nan")).when(F.col("id") % 17 == 5, float("inf")).when(F.col("id") % 17 == 7, float("-inf"))
    df = data[0].withColumn("y", F.coalesce(odd, "y"))
    clean = data[0].withColumn("y", F.when(odd.isNull(), F.col("y")))
    spread, small = PanelSpec(chunk_rows=3), PanelSpec().measured(df)
    want = {"q": ("y", 0.3), "top": ("y", 1.0), "m": (F.col("y") * 2, 0.5)}
    right = ranks.quantiles(clean, ["entity"], want, small)
    n = {"n": F.count(F.lit(1))}
    d = df.groupBy("entity", "y").agg(F.count("*").alias("n"))
    e = clean.filter("y is not null").groupBy("entity", "y").agg(F.count("*").alias("n"))
    below = ranks.weight_below(e, ["entity"], "y", "n", small)
    ranked = ranks.rank_pct(clean, ["entity"], ["y"], small, "_r").select("id", "y_r")
    for spec in (spread, small):
        same(ranks.quantiles(df, ["entity"], want, spec), right, "entity")
        same(profile.summarize(df, ["entity"], n, want, spec), profile.summarize(clean, ["entity"], n, want, small), "entity")
        got = ranks.weight_below(d, ["entity"], "y", "n", spec)
        same(got.filter("y is not null"), below, ["entity", "y"])
        assert got.filter("y is null and below is null").count() == d.count() - below.count() > 0
        same(ranks.rank_pct(df, ["entity"], ["y"], spec, "_r").select("id", "y_r"), ranked, "id")
        got = profile.empirical_pctl(df, df, "y", spec).drop("y")
        same(got, profile.empirical_pctl(clean, clean, "y", small).drop("y"), "id")


def test_long_std_forgets_a_spike(spark):
    rows = [("a", i, 1e6 * (i + 1) / 100 if i < 100 else 5.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "entity string, id long, target double")
    df = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int))"))
    windows = [168, 169, 720]
    for spec in (PanelSpec().measured(df, "ts"), PanelSpec(chunk_rows=100)):
        got = window.rolling(df, spec, ["target"], windows).collect()
        assert len(got) == 1000
        for n in windows:
            flat = [r for r in got if r.id >= 100 + n]
            assert flat and all(r[f"target_roll_std_{n}"] == 0 and r[f"target_roll_mean_{n}"] == 5 for r in flat)
        slow = window.slow_state(df, spec, "target").filter("id >= 820").collect()
        assert len(slow) == 180 and all(r.target_roll_std_720 == 0 for r in slow)
        moved = window.volatility(df, spec, ["target"]).filter("id >= 780").collect()
        assert all(r.target_vol_28d == 0 and r.target_vol_z_7d_28d == 0 for r in moved)


@pytest.mark.parametrize("n", [0, 1, 7, 60, 10_000])
def test_first_rows(data, monkeypatch, n):
    df, _ = data
    order = [F.col("x").isNull(), -F.col("x"), F.col("id")]
    want = [r.id for r in df.orderBy(F.col("x").desc_nulls_last(), "id").limit(n).collect()]
    assert sorted(r.id for r in ranks.first_rows(df, order, n).collect()) == sorted(want)
    monkeypatch.setattr(ranks, "GATHERED", 0)
    assert sorted(r.id for r in ranks.first_rows(df.repartition(7), order, n).collect()) == sorted(want)
