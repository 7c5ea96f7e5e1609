"""Pair correlations of many names, ranks with gaps and long lags against pandas."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import corr as K
from panelkit.plans.layout import PanelSpec


@pytest.fixture(scope="module")
def wide_pdf():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 13)) + 0.5 * rng.normal(size=(400, 13))
    pdf = pd.DataFrame(np.round(base, 2) + 1000.0, columns=[f"e{i}" for i in range(13)])
    pdf.loc[rng.random(400) < 0.2, ["e1", "e2"]] = np.nan  # gaps in the same places
    pdf.loc[rng.random(400) < 0.1, "e3"] = np.nan
    pdf["e4"] = 7.25
    pdf.loc[:, "e5"] = np.nan
    pdf["ts"] = pd.date_range("2024-01-01", periods=400, freq="h")
    return pdf


@pytest.fixture(scope="module")
def long(spark, wide_pdf):
    rows = wide_pdf.melt("ts", var_name="entity", value_name="target")
    rows = [(r.entity, r.ts.to_pydatetime(), i, None if pd.isna(r.target) else r.target) for i, r in enumerate(rows.itertuples())]
    df = spark.createDataFrame(rows, "entity string, ts timestamp_ntz, id long, target double").cache()
    return df, PanelSpec().measured(df)


NAMES = [f"e{i}" for i in range(13)]


def table(df, *keys):
    return {tuple(r[k] for k in (*keys, "a", "b")): (r["n"], r["corr"]) for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for key, (n, r) in want.items():
        assert got[key][0] == n, key
        if r is None or np.isnan(r):
            assert got[key][1] is None, key
        else:
            assert got[key][1] == pytest.approx(r, abs=1e-9), key


def pandas_corr(pdf, method):
    out = {}
    for a, b in itertools.combinations(NAMES, 2):
        both = pdf[[a, b]].dropna()
        r = np.nan if both[a].nunique() < 2 or both[b].nunique() < 2 else (both.rank() if method == "spearman" else both).corr().iloc[0, 1]
        out[a, b] = (len(both), r)
    return out


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("few", [0, 1000])
def test_matrix(long, wide_pdf, method, few, monkeypatch):
    monkeypatch.setattr(K, "FEW_PAIRS", few)
    df, spec = long
    close(table(K.corr_matrix(df, spec, NAMES, method)), pandas_corr(wide_pdf, method))


def test_groups_one_pass(long, wide_pdf, monkeypatch):
    df, spec = long
    by_hour = {few: None for few in (0, 1000)}
    for few in by_hour:
        monkeypatch.setattr(K, "FEW_PAIRS", few)
        out = K.corr_by(df, spec, NAMES, "hour", min_rows=10)
        by_hour[few] = table(out, "hour")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1
    close(by_hour[0], by_hour[1000])
    want = wide_pdf[wide_pdf["ts"].dt.hour == 3][["e0", "e6"]].corr().iloc[0, 1]
    assert by_hour[0][3, "e0", "e6"][1] == pytest.approx(want, abs=1e-9)


def test_many_runs_read_the_source_once(spark):
    rows = spark.range(300).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r"))
    runs = [f"run {i}" for i in range(40)]
    long = rows.select(F.concat(F.lit("run "), "r").alias("run"), "id", F.rand(3).alias("pred"))
    got = K.prediction_similarity(long, runs)
    assert got.count() == 780
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_feature_maps_agree(long, monkeypatch):
    df, spec = long
    df = df.withColumns({"f": F.col("target") * 2 + F.hour("ts"), "g": F.sin("target")})
    some = NAMES[:9]
    tables = []
    for few in (0, 1000):
        monkeypatch.setattr(K, "FEW_PAIRS", few)
        tables.append(table(K.feature_target_map(df, spec, some, ["f", "g"]), "feature"))
    close(*tables)


def test_missing_kinds(spark):
    wide = spark.createDataFrame([(1.0, float("nan")), (2.0, 1.0), (None, 3.0), (4.0, 5.0)], "a double, `b c` double")
    for few in (0, 5):
        K_few, K.FEW_PAIRS = K.FEW_PAIRS, few
        try:
            assert [(r.n, r.corr) for r in K._pair_rows(wide, [], [("a", "b c")]).collect()] == [(2, 1.0)]
        finally:
            K.FEW_PAIRS = K_few
    assert K._pair_rows(wide.filter("false"), [], [("a", "b c")]).collect()[0].n == 0


@pytest.mark.parametrize("rows", [37, 50_000])
def test_lead_lag(long, wide_pdf, rows, monkeypatch):
    monkeypatch.setattr(K, "LEAD_ROWS", rows)
    df, spec = long
    lags = [-30, -1, 0, 1, 2, 24, 30]
    got = {(r.b, r.lag): r["corr"] for r in K.lead_lag(df, spec, NAMES[:6], "e0", lags).collect()}
    assert len(got) == 5 * len(lags)
    for (b, lag), r in got.items():
        x, y = (wide_pdf["e0"], wide_pdf[b].shift(lag)) if lag >= 0 else (wide_pdf["e0"].shift(-lag), wide_pdf[b])
        want = np.nan if b in ("e4", "e5") else x.corr(y)
        assert (r is None) if np.isnan(want) else r == pytest.approx(want, abs=1e-9), (b, lag)
