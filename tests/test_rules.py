"""Hand-computed frames: missing values, ties, single rows, unseen cells, bad input."""

import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.functions import contract as C
from panelkit.functions import scalar as S
from panelkit.operators import blend as I
from panelkit.operators import folds as G
from panelkit.operators import joins as J
from panelkit.operators import metrics as H
from panelkit.operators import model as M
from panelkit.operators import profile as P
from panelkit.operators import select as B
from panelkit.operators import window as Wn
from panelkit.plans.layout import PanelSpec
from panelkit.sources import io
from tests.helpers import SCHEMA

T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    """(entity, hour offset, target, x) rows with running ids."""
    full = [
        (e, datetime(2024, 1, 1 + h // 24, h % 24), i, t, x, None)
        for i, (e, h, t, x) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def column(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_missing_values_in_flags_and_clips(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan"))], "id int, x double")
    df = C.clean_numbers(df)
    out = df.select(
        "id",
        C.flag(F.col("x") >= 1.0).alias("f"),
        C.clip("x", 0.0, 1.0).alias("c"),
        C.ratio("x", F.lit(-1e-6)).alias("r"),
    )
    assert [(r.f, r.c, r.r) for r in out.orderBy("id").collect()] == [
        (0, None, None), (1, 1.0, None), (0, None, None)
    ]


def test_safe_corr_on_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 5.0)], "x double, y double")
    assert df.agg(C.safe_corr("x", "y")).first()[0] is None


def test_lags_count_rows_not_hours(spark):
    df = frame(spark, [("a", 0, 1.0, None), ("a", 5, 2.0, None), ("a", 9, 3.0, None), ("b", 0, 9.0, None)])
    spec = PanelSpec().measured(df)
    assert column(Wn.lags(df, spec, ["target"], [1]), "target_lag_1") == [None, 1.0, 2.0, None]


def test_rolling_needs_enough_values_and_excludes_own_row(spark):
    df = frame(spark, [("a", h, float(h), None if h == 1 else float(h)) for h in range(5)])
    spec = PanelSpec().measured(df)
    out = Wn.rolling(df, spec, ["x"], [3], ["mean", "std"])
    assert column(out, "x_roll_mean_3") == [None, 0.0, 0.0, 1.0, 2.5]
    std = column(out, "x_roll_std_3")
    assert std[:3] == [None, None, None] and std[3] == pytest.approx(math.sqrt(2.0))


def test_future_rows_do_not_change_the_past(spark):
    rows = [("a", h, float(h * h % 17), float(h % 5)) for h in range(40)]
    a, b = frame(spark, rows), frame(spark, rows[:30] + [("a", h, -99.0, 99.0) for h in range(30, 40)])
    spec = PanelSpec().measured(a)

    def built(df):
        df = Wn.rolling(Wn.lags(df, spec, ["target"], [1, 3]), spec, ["x"], [6])
        df = Wn.expanding_prev(df, spec, ["entity"], "target", "p")
        return [tuple(r)[4:] for r in df.filter("id < 30").drop("target", "x").orderBy("id").collect()]

    assert built(a) == built(b)


def test_rank_ties_and_missing(spark):
    df = frame(spark, [("a", 0, 1.0, 5.0), ("b", 0, 1.0, 5.0), ("c", 0, 1.0, 7.0), ("d", 0, 1.0, None)])
    spec = PanelSpec().measured(df, "ts")
    assert column(Wn.pct_rank_avg(df, spec, ["x"]), "x_xmk_rank_pct") == [0.5, 0.5, 1.0, None]


def test_profile_of_unseen_cell_backs_off(spark):
    df = S.calendar(frame(spark, [("a", 0, 10.0, None), ("a", 1, 20.0, None), ("b", 0, 99.0, None)]))
    train = df.filter("entity = 'a' AND hour = 0")
    spec = PanelSpec().measured(df)
    out = P.backoff(P.profiles(train, df, spec), P.overall_stats(train))
    assert column(out, "profile_mhd_mean") == [10.0, 10.0, 10.0]
    assert column(out, "profile_mhd_count") == [1, 0, 0]
    assert column(out, "profile_m_std") == [None, None, 0.0] or column(out, "profile_m_std")[2] == 0.0


def test_quantile_bins_merge_equal_edges(spark):
    df = frame(spark, [("a", h, 1.0, v) for h, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 9.0, None])])
    train = df.filter("id < 6")
    spec = PanelSpec().measured(df)
    assert column(P.quantile_bins(train, df, "x", 4, spec, "bin"), "bin") == [0, 0, 0, 0, 1, 1, None, None]


def test_empirical_percentile_can_exceed_one(spark):
    df = frame(spark, [("a", h, 1.0, v) for h, v in enumerate([1.0, 2.0, 2.0, 4.0, 9.0])])
    out = P.empirical_pctl(df.filter("id < 4"), df, "x", PanelSpec().measured(df))
    assert column(out, "x_pctl") == pytest.approx([0.5 / 3, 2 / 3, 2 / 3, 3.5 / 3, 4 / 3])


def test_last_day_is_left_out_only_with_exclusive_end(spark):
    df = frame(spark, [("a", 24 * d, 1.0, None) for d in range(12)])
    spec = PanelSpec().measured(df)
    last = lambda **k: G.rolling_date_folds(df, spec, 1, 3, 3, 2, **k).first()["val_end"]
    assert last() == datetime(2024, 1, 12) and last(end_exclusive=False) == datetime(2024, 1, 13)
    assert G.rolling_day_folds(df, spec, 1, 3, 3, 2).first()["val_end"] == datetime(2024, 1, 13)
    roles = G.assign_folds(df, G.rolling_date_folds(df, spec, 2, 3, 3, 2), spec)
    bad = roles.groupBy("fold").pivot("role", ["train", "val"]).agg(F.max("ts"), F.min("ts"))
    for r in bad.collect():
        assert r["train_max(ts)"] < r["val_min(ts)"]


def test_joins_fail_on_bad_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError, match="unique"):
        J.join_one_to_one(a, spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, v int"), "id")
    with pytest.raises(ValueError, match="without a match"):
        J.join_one_to_one(a, spark.createDataFrame([(1, 1)], "id int, v int"), "id")
    with pytest.raises(ValueError, match="lack ids"):
        J.assert_same_ids({"a": a, "b": spark.createDataFrame([(1,)], "id int")})
    with pytest.raises(ValueError, match="missing columns"):
        C.require_columns(a, ["nope"])


def test_csv_sources(spark, tmp_path):
    p = tmp_path / "panel.csv"
    p.write_text("id,ts,v,note\n1,2024-01-01 00:00:00,2.5,a\n2.0,oops,NaN,b\nx,2024-01-02,zz,\n")
    schema = {"id": "bigint", "ts": "timestamp_ntz", "v": "double", "note": "string"}
    rows = io.read_panel(spark, str(p), schema, strict_ts=False).collect()
    assert [(r.id, r.v) for r in rows] == [(1, 2.5), (2, None), (None, None)]
    assert rows[1].ts is None and rows[2].ts == datetime(2024, 1, 2)
    with pytest.raises(Exception, match="unreadable timestamp"):
        io.read_panel(spark, str(p), schema).collect()
    with pytest.raises(ValueError, match="missing columns"):
        io.read_panel(spark, str(p), {"absent": "double"})
    pred = tmp_path / "pred.csv"
    pred.write_text("id,target\n1,2.0\n1,4.0\nx,1.0\n3,\n4,5.5\n")
    got = io.read_predictions(spark, str(pred), dedupe=True).orderBy("id").collect()
    assert [(r.id, r.target) for r in got] == [(1, 3.0), (4, 5.5)]


def test_write_refuses_missing_predictions(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    pred = spark.createDataFrame([(1, 0.5), (2, None)], "id bigint, target double")
    with pytest.raises(ValueError, match="1 expected ids"):
        io.write_predictions(pred, ids, str(tmp_path / "out"))
    io.write_predictions(pred.fillna(1.0), ids, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_constant_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, None, "a"), (1.0, None, 2.0, "b")], "c double, n double, h double, s string"
    )
    assert B.constant_columns(df, ["c", "n", "h", "s"]) == ["c", "n"]


def test_topk_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)] + [(9, 1.0)], "id bigint, target double")
    out = I.replace_topk(df, 2, "largest", "mean_non_topk", PanelSpec(bounds={}))
    assert [r.id for r in out.filter("replaced = 1").orderBy("id").collect()] == [0, 1]
    assert out.filter("replaced = 1").first()["target"] == pytest.approx(11 / 3)


def test_soft_cap_keeps_order_of_bounds(spark):
    df = S.calendar(frame(spark, [("a", 0, float(v), None) for v in range(10)]))
    spec = PanelSpec().measured(df)
    caps = I.soft_cap_fit(df, spec, 0.2, 0.8, 1, {"a": {"lower_q": 0.9, "upper_q": 0.1}})
    out = I.soft_cap_apply(df.withColumn("p", F.col("target") * 2 - 5), caps, spec, "p", 0.5)
    low, high = 1.8, 7.2
    want = [
        low + 0.5 * (p - low) if p < low else high + 0.5 * (p - high) if p > high else p
        for p in (v * 2 - 5 for v in range(10))
    ]
    assert sorted(column(out, "p")) == pytest.approx(sorted(want))


def test_metrics_of_one_row(spark):
    df = frame(spark, [("a", 0, 3.0, None)]).withColumn("pred", F.lit(5.0))
    r = H.error_metrics(df, PanelSpec().measured(df)).first()
    assert (r["n"], r["rmse"], r["bias"], r["p95_abs_error"]) == (1, 2.0, 2.0, 2.0)


def test_gate_defaults_when_a_class_is_missing(spark):
    df = frame(spark, [("a", h, 1.0, float(h)) for h in range(5)]).withColumn("label", F.lit(0))
    gate = M.fit_gate(df, ["x"], "label", PanelSpec().measured(df))
    assert column(gate.predict(df), "prob") == [0.15] * 5


def test_known_easters(spark):
    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2024: (3, 31), 2038: (4, 25)}
    df = spark.createDataFrame([(y,) for y in known], "year int")
    for r in df.select("year", S.easter_sunday(F.col("year")).alias("d")).collect():
        assert (r.d.month, r.d.day) == known[r.year]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=6))
def test_transforms_invert(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, y double")
    shift = S.shift_for_log(df, "y")
    z = df.select(
        "y",
        S.target_inverse(S.target_transform("y", "signed_log"), "signed_log").alias("a"),
        S.target_inverse(S.target_transform("y", "log_shift", shift), "log_shift", shift).alias("b"),
        S.yeo_johnson_inverse(S.yeo_johnson("y", 0.7), 0.7).alias("c"),
    )
    for r in z.collect():
        for c in "abc":
            assert r[c] == pytest.approx(r["y"], rel=1e-6, abs=1e-6)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0.01, 100), min_size=2, max_size=5))
def test_weights_sum_to_one(spark, errors):
    df = spark.createDataFrame([(str(i), float(e)) for i, e in enumerate(errors)], "name string, rmse double")
    got = [r.weight for r in I.inverse_error_weights(df).collect()]
    assert sum(got) == pytest.approx(1.0)


def test_tables_go_to_the_shared_folder_of_the_session(spark, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == "spark.checkpoint.dir" else default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert io.new_path(Session(), "t").startswith(str(tmp_path))
    df = spark.range(3)
    assert io.materialize(df).count() == 3
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or io.shared_dir(spark) == named


def test_written_predictions_are_read_back(spark, tmp_path):
    pred = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, target double")
    for form in ("csv", "parquet"):
        path = f"{tmp_path}/{form}"
        io.write_predictions(pred, pred, path, form)
        for named in (None, form):
            assert sorted(tuple(r) for r in io.read_predictions(spark, path, form=named).collect()) == [(1, 0.5), (2, 1.5)]


def test_power_is_narrowed_down(spark):
    df = spark.range(400).select((F.exp(F.col("id") / 100) - 2).alias("y"))
    coarse, fine = S.fit_yeo_johnson(df, "y"), S.fit_yeo_johnson(df, "y", tol=1e-4)
    dense = S.fit_yeo_johnson(df, "y", [coarse - 0.1 + i * 1e-3 for i in range(201)])
    assert abs(fine - dense) < 1.1e-3 and abs(fine - coarse) <= 0.1
    at_zero = df.select("y", S.yeo_johnson("y", 1e-17).alias("a"), S.yeo_johnson("y", 0.0).alias("b"))
    assert at_zero.filter("abs(a - b) > 1e-12").count() == 0


def test_drop_constant_query_keeps_its_columns(spark, tmp_path):
    """``half`` has one value where every hour has a w2, and none where no hour has."""
    from catalog import QUERIES

    for user, half in ((5, 1.0), (3, None)):
        rows = [(i, datetime(2024, 1, 1, i), user, "ab"[i % 2], float(i)) for i in range(6)]
        events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        events.write.parquet(str(tmp_path / str(user) / "events.parquet"))
        got = QUERIES["B4_drop_constant"](spark, str(tmp_path / str(user))).collect()
        want = [("ab"[i % 2], 10, float(i), half, float(i) if half else None) for i in range(6)]
        assert sorted((r.entity, r.n_columns, r.target, r.half, r.w2) for r in got) == sorted(want, key=lambda r: (r[0], r[2]))
