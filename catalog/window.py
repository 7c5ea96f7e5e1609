"""Queries for ordered windows and cross-sections."""

from itertools import combinations

from pyspark.sql import functions as F

from catalog.common import DAILY, HOURLY_CAL, register, shape
from catalog.scalar import cal
from panelkit.functions import scalar as S
from panelkit.operators import window as Wn
from panelkit.plans import panels
from panelkit.plans.panels import SPEC

W = "WINDOW w AS (PARTITION BY entity ORDER BY ts, id)"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def hourly(spark, sf, *by):
    df = cal(spark, sf)
    return df, SPEC.measured(df, *by)


def daily(spark, sf, *by):
    df = S.residual_load(panels.daily(spark, sf))
    return df, SPEC.measured(df, *by)


DAILY_RES = DAILY + """, cal AS (
  SELECT *, load_forecast - wind_forecast - solar_forecast AS residual_load FROM panel)"""


def roll(c: str, n: int, fn: str, need: int) -> str:
    """SQL of one guarded rolling aggregate over the previous n rows."""
    sql_fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[fn]
    over = f"OVER (PARTITION BY entity ORDER BY ts, id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {over} >= {need} THEN {sql_fn}({c}) {over} END"


def _lags(s, d):
    df, spec = hourly(s, d)
    return Wn.lags(df, spec, ["load_forecast", "wind_forecast", "residual_load"], [1, 2, 24, 168])


register(
    "D1_lags",
    shape(
        "entity ts",
        "",
        " ".join(
            f"{c}_lag_{k}"
            for c in ("load_forecast", "wind_forecast", "residual_load")
            for k in (1, 2, 24, 168)
        ),
    ),
    _lags,
    f"WITH {HOURLY_CAL} SELECT entity, ts, "
    + ", ".join(
        f"lag({c}, {k}) OVER w AS {c}_lag_{k}"
        for c in ("load_forecast", "wind_forecast", "residual_load")
        for k in (1, 2, 24, 168)
    )
    + f" FROM cal {W}",
)


def _diffs(s, d):
    df, spec = hourly(s, d)
    return Wn.diffs(df, spec, ["load_forecast", "wind_forecast"], [1, 6, 24], absolute=True)


register(
    "D2_diffs",
    shape(
        "entity ts",
        "",
        " ".join(
            f"{c}_{kind}_{k}"
            for c in ("load_forecast", "wind_forecast")
            for kind in ("diff", "absdiff")
            for k in (1, 6, 24)
        ),
    ),
    _diffs,
    f"WITH {HOURLY_CAL} SELECT entity, ts, "
    + ", ".join(
        f"{c} - lag({c}, {k}) OVER w AS {c}_diff_{k}, abs({c} - lag({c}, {k}) OVER w) AS {c}_absdiff_{k}"
        for c in ("load_forecast", "wind_forecast")
        for k in (1, 6, 24)
    )
    + f" FROM cal {W}",
)

ROLLS = [
    (c, fn, n) for c in ("target", "wind_forecast") for n in (6, 24, 72) for fn in ("mean", "std", "min", "max")
]


def _rolling(s, d):
    df, spec = hourly(s, d)
    return Wn.rolling(
        df, spec, ["target", "wind_forecast"], [6, 24, 72], ["mean", "std", "min", "max"]
    )


register(
    "D3_rolling",
    shape("entity ts", "", " ".join(f"{c}_roll_{fn}_{n}" for c, fn, n in ROLLS)),
    _rolling,
    f"WITH {HOURLY_CAL} SELECT entity, ts, "
    + ", ".join(
        f"{roll(c, n, fn, 2 if fn == 'std' else 1)} AS {c}_roll_{fn}_{n}" for c, fn, n in ROLLS
    )
    + " FROM cal",
)


def _anomaly(s, d):
    df, spec = hourly(s, d)
    return Wn.anomaly(df, spec, ["load_forecast", "wind_forecast"])


register(
    "D4_anomaly",
    shape(
        "entity ts",
        "",
        " ".join(
            f"{c}_{k}"
            for c in ("load_forecast", "wind_forecast")
            for k in ("anom_24", "anom_168", "z_168")
        ),
        5,
    ),
    _anomaly,
    f"WITH {HOURLY_CAL} SELECT entity, ts, "
    + ", ".join(
        f"{c} - {roll(c, 24, 'mean', 6)} AS {c}_anom_24, "
        f"{c} - {roll(c, 168, 'mean', 24)} AS {c}_anom_168, "
        f"({c} - {roll(c, 168, 'mean', 24)}) / ({roll(c, 168, 'std', 24)} + 1e-6::DOUBLE) AS {c}_z_168"
        for c in ("load_forecast", "wind_forecast")
    )
    + " FROM cal",
)


def _volatility(s, d):
    df, spec = daily(s, d)
    return Wn.volatility(df, spec, ["load_forecast"])


register(
    "D5_volatility",
    shape(
        "entity ts",
        "load_forecast_vol_regime_high",
        "load_forecast_absdiff_1 load_forecast_vol_7d load_forecast_vol_28d "
        "load_forecast_vol_ratio_7d_28d load_forecast_vol_z_7d_28d",
        3,
    ),
    _volatility,
    f"""WITH {DAILY_RES}, a AS (
        SELECT *, abs(load_forecast - lag(load_forecast) OVER w) AS a FROM cal {W}),
      v AS (SELECT *, {roll("a", 168, "mean", 24)} AS v7, {roll("a", 672, "mean", 48)} AS v28,
        {roll("a", 672, "std", 48)} AS s28 FROM a)
      SELECT entity, ts, a AS load_forecast_absdiff_1, v7 AS load_forecast_vol_7d,
        v28 AS load_forecast_vol_28d, v7 / (v28 + 1e-6::DOUBLE) AS load_forecast_vol_ratio_7d_28d,
        (v7 - v28) / (s28 + 1e-6::DOUBLE) AS load_forecast_vol_z_7d_28d,
        coalesce(v7 / (v28 + 1e-6::DOUBLE) > 1.15::DOUBLE, false)::INT AS load_forecast_vol_regime_high
      FROM v""",
)


def _slow(s, d):
    df, spec = daily(s, d)
    return Wn.slow_state(df, spec, "load_forecast")


register(
    "D6_slow_state",
    shape(
        "entity ts",
        "",
        " ".join(f"load_forecast_roll_{fn}_{n}" for n in (24, 168, 720) for fn in ("mean", "std")),
        3,
    ),
    _slow,
    f"WITH {DAILY_RES} SELECT entity, ts, "
    + ", ".join(
        f"{roll('load_forecast', n, fn, max(6, n // 4))} AS load_forecast_roll_{fn}_{n}"
        for n in (24, 168, 720)
        for fn in ("mean", "std")
    )
    + " FROM cal",
)


def _transition(s, d):
    df, spec = hourly(s, d)
    return Wn.transition(df, spec)


TRANSITION_SQL = f"""lag(residual_load) OVER w AS residual_load_lag_1,
  residual_load - lag(residual_load) OVER w AS residual_load_diff_1,
  abs(residual_load - lag(residual_load) OVER w) AS abs_residual_ramp_1,
  residual_load - lag(residual_load, 6) OVER w AS residual_load_diff_6,
  abs(residual_load - lag(residual_load, 6) OVER w) AS abs_residual_ramp_6,
  {roll("residual_load", 6, "std", 6)} AS residual_load_roll_std_6"""
register(
    "D7_transition",
    shape(
        "entity ts",
        "",
        "residual_load_lag_1 residual_load_diff_1 abs_residual_ramp_1 residual_load_diff_6 "
        "abs_residual_ramp_6 residual_load_roll_std_6",
    ),
    _transition,
    f"WITH {HOURLY_CAL} SELECT entity, ts, {TRANSITION_SQL} FROM cal {W}",
)


def _exog(s, d):
    df, spec = hourly(s, d)
    return Wn.exog_block(df, spec, ["load_forecast"], ["click", "view"])


_exog_sql = {
    **{f"load_forecast_lag_{k}": f"lag(load_forecast, {k}) OVER w" for k in Wn.EXOG_LAGS},
    **{
        f"load_forecast_ramp_{k}": f"load_forecast - lag(load_forecast, {k}) OVER w"
        for k in Wn.EXOG_LAGS
    },
    **{
        f"load_forecast_roll_{fn}_{n}": roll("load_forecast", n, fn, 4)
        for n in Wn.EXOG_WINDOWS
        for fn in ("mean", "std")
    },
}
register(
    "D8_exog_block",
    shape("entity ts", "exog_lag_enabled", " ".join(_exog_sql)),
    _exog,
    f"""WITH {HOURLY_CAL} SELECT entity, ts, (entity IN ('click', 'view'))::INT AS exog_lag_enabled, """
    + ", ".join(
        f"CASE WHEN entity IN ('click', 'view') THEN {sql} ELSE 0 END AS {name}"
        for name, sql in _exog_sql.items()
    )
    + f" FROM cal {W}",
)


def _expanding(s, d):
    df, spec = hourly(s, d)
    return Wn.expanding_prev(df, spec, ["entity", "hour"], "target", "p")


EXPANDING_SQL = """SELECT *, sqrt(greatest(p_dyn_sq_mean - p_dyn_mean * p_dyn_mean, 0)) AS p_dyn_std,
    sqrt(p_dyn_sq_mean) AS p_dyn_rms FROM (
  SELECT *, p_sum / nullif(p_dyn_count, 0) AS p_dyn_mean, p_sq / nullif(p_dyn_count, 0) AS p_dyn_sq_mean FROM (
    SELECT *, (count(*) OVER e)::DOUBLE AS p_dyn_count, sum(target) OVER e AS p_sum,
      sum(target * target) OVER e AS p_sq FROM cal
    WINDOW e AS (PARTITION BY {keys} ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
register(
    "D9_expanding_prev",
    shape("entity ts", "", "p_dyn_count p_dyn_mean p_dyn_sq_mean p_dyn_std p_dyn_rms", 4),
    _expanding,
    f"""WITH {HOURLY_CAL}, x AS ({EXPANDING_SQL.format(keys="entity, hour")})
      SELECT entity, ts, p_dyn_count, p_dyn_mean, p_dyn_sq_mean,
        CASE WHEN p_dyn_mean IS NOT NULL THEN p_dyn_std END AS p_dyn_std, p_dyn_rms FROM x""",
)


def _cross(s, d):
    df, spec = hourly(s, d, "ts")
    return Wn.cross_section(df, spec, ["load_forecast", "wind_forecast"])


def cross_sql(c: str) -> str:
    return f"""avg({c}) OVER t AS {c}_xmk_mean, stddev_samp({c}) OVER t AS {c}_xmk_std,
      {c} - avg({c}) OVER t AS {c}_xmk_diff,
      ({c} - avg({c}) OVER t) / (stddev_samp({c}) OVER t + 1e-6::DOUBLE) AS {c}_xmk_z"""


register(
    "D10_cross_section",
    shape(
        "entity ts",
        "",
        " ".join(
            f"{c}_xmk_{k}"
            for c in ("load_forecast", "wind_forecast")
            for k in ("mean", "std", "diff", "z")
        ),
        5,
    ),
    _cross,
    f"""WITH {HOURLY_CAL} SELECT entity, ts, {cross_sql("load_forecast")}, {cross_sql("wind_forecast")}
      FROM cal WINDOW t AS (PARTITION BY ts)""",
)


def rank_sql(c: str, by: str = "ts") -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST)
      + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY {by}) END"""


def _rank(s, d):
    df, spec = hourly(s, d, "ts")
    return Wn.pct_rank_avg(df, spec, ["load_forecast", "w2"])


register(
    "D11_pct_rank_avg",
    shape("entity ts", "", "load_forecast_xmk_rank_pct w2_xmk_rank_pct"),
    _rank,
    f"""WITH {HOURLY_CAL} SELECT entity, ts, {rank_sql("load_forecast")} AS load_forecast_xmk_rank_pct,
      {rank_sql("w2")} AS w2_xmk_rank_pct FROM cal""",
)


def _robust(s, d):
    df, spec = hourly(s, d, "ts")
    return Wn.robust_cross(df, spec, ["load_forecast", "w2"], min_std=1.0, z_clip=1.2)


def robust_sql(c: str, min_std: float, z_clip: float) -> str:
    std, diff = f"stddev_samp({c}) OVER (PARTITION BY ts)", f"({c} - avg({c}) OVER (PARTITION BY ts))"
    z = f"{diff} / ({std} + 1e-6::DOUBLE)"
    return f"""avg({c}) OVER (PARTITION BY ts) AS {c}_xmk_mean, {std} AS {c}_xmk_std, {diff} AS {c}_xmk_diff,
      CASE WHEN {std} > {min_std} THEN
        CASE WHEN {c} IS NOT NULL THEN greatest(least({z}, {z_clip}::DOUBLE), -{z_clip}::DOUBLE) END
        ELSE 0 END AS {c}_xmk_z,
      CASE WHEN {std} > {min_std} THEN {rank_sql(c)} ELSE 0.5 END AS {c}_xmk_rank_pct"""


register(
    "D12_robust_cross",
    shape(
        "entity ts",
        "",
        " ".join(
            f"{c}_xmk_{k}" for c in ("load_forecast", "w2") for k in ("mean", "std", "diff", "z", "rank_pct")
        ),
        5,
    ),
    _robust,
    f"""WITH {HOURLY_CAL} SELECT entity, ts, {robust_sql("load_forecast", 1.0, 1.2)},
      {robust_sql("w2", 1.0, 1.2)} FROM cal""",
)


def _extreme(s, d):
    df, spec = hourly(s, d, "ts")
    return Wn.extreme_flags(df, spec, ["load_forecast", "wind_forecast"], bottom=0.25)


register(
    "D13_extreme_flags",
    shape(
        "entity ts",
        "is_top10_load_forecast is_bottom10_load_forecast is_top10_wind_forecast "
        "is_bottom10_wind_forecast",
    ),
    _extreme,
    f"""WITH {HOURLY_CAL}, r AS (SELECT *, {rank_sql("load_forecast")} AS a,
        {rank_sql("wind_forecast")} AS b FROM cal)
      SELECT entity, ts, coalesce(a >= 0.9::DOUBLE, false)::INT AS is_top10_load_forecast,
        coalesce(a <= 0.25::DOUBLE, false)::INT AS is_bottom10_load_forecast,
        coalesce(b >= 0.9::DOUBLE, false)::INT AS is_top10_wind_forecast,
        coalesce(b <= 0.25::DOUBLE, false)::INT AS is_bottom10_wind_forecast FROM r""",
)


def _pair_corr(s, d):
    df, spec = hourly(s, d)
    return Wn.rolling_pair_corr(df, spec, list(combinations(EVENT_TYPES, 2)), 48, 12)


WIDE = """times AS (SELECT DISTINCT ts FROM panel), pairs AS (
    SELECT t.ts, a.entity AS a, b.entity AS b, pa.target AS x, pb.target AS y
    FROM times t, (SELECT DISTINCT entity FROM panel) a, (SELECT DISTINCT entity FROM panel) b
    LEFT JOIN panel pa ON pa.ts = t.ts AND pa.entity = a.entity
    LEFT JOIN panel pb ON pb.ts = t.ts AND pb.entity = b.entity
    WHERE {cond}),
  full_pairs AS (SELECT ts, a, b, CASE WHEN y IS NOT NULL THEN x END AS x,
    CASE WHEN x IS NOT NULL THEN y END AS y FROM pairs)"""


def pair_corr_sql(n: int, need: int) -> str:
    """Rolling correlation of full_pairs over the n timestamps before each."""
    over = f"OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""SELECT a, b, ts, CASE WHEN count(x) {over} >= {need} AND stddev_samp(x) {over} > 0
        AND stddev_samp(y) {over} > 0 THEN greatest(-1, least(1,
          covar_samp(x, y) {over} / (stddev_samp(x) {over} * stddev_samp(y) {over}))) END AS corr
      FROM full_pairs"""


register(
    "D14_rolling_pair_corr",
    shape("a b ts", "", "corr"),
    _pair_corr,
    f"WITH {HOURLY_CAL}, {WIDE.format(cond='a.entity < b.entity')} {pair_corr_sql(48, 12)}",
)


def _residual(s, d):
    df, spec = daily(s, d)
    return Wn.residual_rolling(df, spec, "load_forecast")


register(
    "D15_residual_rolling",
    shape(
        "entity ts",
        "",
        "load_forecast_lag1 load_forecast_lag24 load_forecast_delta_1 load_forecast_delta_24 "
        "load_forecast_rollmean_30d load_forecast_vs_30d",
        3,
    ),
    _residual,
    f"""WITH {DAILY_RES} SELECT entity, ts, lag(load_forecast) OVER w AS load_forecast_lag1,
      lag(load_forecast, 24) OVER w AS load_forecast_lag24,
      load_forecast - lag(load_forecast) OVER w AS load_forecast_delta_1,
      load_forecast - lag(load_forecast, 24) OVER w AS load_forecast_delta_24,
      {roll("load_forecast", 720, "mean", 24)} AS load_forecast_rollmean_30d,
      load_forecast - {roll("load_forecast", 720, "mean", 24)} AS load_forecast_vs_30d FROM cal {W}""",
)
