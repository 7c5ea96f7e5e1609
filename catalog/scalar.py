"""Queries for row-wise features."""

from pyspark.sql import functions as F

from catalog.common import DAILY, HOURLY, HOURLY_CAL, register, shape
from panelkit.functions import scalar as S
from panelkit.operators.window import diffs
from panelkit.plans import panels
from panelkit.plans.panels import SPEC

# Stand-ins for the weather columns, so that the operators run under their usual names.
WEATHER = {
    "wind_speed_10m": ("w2", lambda: F.col("w2")),
    "wind_gust_speed_10m": ("w1", lambda: F.col("w1")),
    "wind_speed_80m": ("target / 4", lambda: F.col("target") / 4),
    "wind_direction_80m": ("w1", lambda: F.col("w1")),
    "direct_normal_irradiance": ("solar_forecast", lambda: F.col("solar_forecast")),
    "global_horizontal_irradiance": ("load_forecast", lambda: F.col("load_forecast")),
    "diffuse_horizontal_irradiance": ("wind_forecast", lambda: F.col("wind_forecast")),
    "cloud_cover_low": ("w2", lambda: F.col("w2")),
    "cloud_cover_total": ("w1", lambda: F.col("w1")),
    "air_temperature_2m": ("target / 2 - 5.0::DOUBLE", lambda: F.col("target") / 2 - 5.0),
    "dew_point_temperature_2m": ("w2", lambda: F.col("w2")),
    "apparent_temperature_2m": ("w1 / 4", lambda: F.col("w1") / 4),
    "convective_available_potential_energy": ("w1 * 10", lambda: F.col("w1") * 10),
    "convective_inhibition": ("-w2", lambda: -F.col("w2")),
    "lifted_index": ("w2 - 5.0::DOUBLE", lambda: F.col("w2") - 5.0),
}
MET = (
    HOURLY_CAL
    + ", met AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, (sql, _) in WEATHER.items())
    + " FROM cal)"
)


def cal(spark, sf):
    return S.residual_load(S.calendar(panels.hourly(spark, sf)))


def met(spark, sf):
    return cal(spark, sf).withColumns({name: make() for name, (_, make) in WEATHER.items()})


register(
    "C1_calendar",
    shape("entity ts", "hour dow day month weekofyear is_weekend is_winter"),
    lambda s, d: S.calendar(panels.daily(s, d)),
    f"""WITH {DAILY} SELECT entity, ts, hour(ts) AS hour, isodow(ts) - 1 AS dow, day(ts) AS day,
      month(ts) AS month, week(ts) AS weekofyear, (isodow(ts) >= 6)::INT AS is_weekend,
      (month(ts) IN (11, 12, 1, 2, 3))::INT AS is_winter FROM panel""",
)

register(
    "C2_harmonics",
    shape(
        "entity ts",
        "",
        "hour_sin_1 hour_cos_1 hour_sin_2 hour_cos_2 hour_sin_3 hour_cos_3 doy_sin doy_cos",
    ),
    lambda s, d: S.year_harmonics(S.harmonics(cal(s, d), "hour", 24)),
    f"WITH {HOURLY_CAL} SELECT entity, ts, "
    + ", ".join(
        f"{fn}(2 * pi() * {k} * (hour / 24.0::DOUBLE)) AS hour_{fn}_{k}"
        for k in (1, 2, 3)
        for fn in ("sin", "cos")
    )
    + """, sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_sin,
      cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_cos FROM cal""",
)

register(
    "C3_duration",
    shape("id", "start_epoch", "duration_hours"),
    lambda s, d: S.duration(
        panels.table(s, d, "events").select(
            F.col("event_id").alias("id"),
            F.to_date("ts").cast("timestamp_ntz").alias("start"),
            F.col("ts").cast("timestamp_ntz").alias("end"),
        ),
        "start",
        "end",
    ),
    """SELECT event_id AS id, epoch(date_trunc('day', ts)::TIMESTAMP)::BIGINT AS start_epoch,
      (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) / 3.6e9::DOUBLE AS duration_hours
      FROM events""",
)

register(
    "C4_hour_flags",
    shape(
        "entity ts",
        "is_morning_peak is_evening_peak is_night_block is_midday_solar is_shoulder_hour "
        "is_18_19 is_midday is_monday is_friday is_weekend_adjacent",
    ),
    lambda s, d: S.hour_flags(cal(s, d)),
    f"""WITH {HOURLY_CAL} SELECT entity, ts, (hour IN (7, 8, 9))::INT AS is_morning_peak,
      (hour BETWEEN 17 AND 20)::INT AS is_evening_peak, (hour <= 5)::INT AS is_night_block,
      (hour BETWEEN 11 AND 14)::INT AS is_midday_solar,
      (hour IN (6, 10, 15, 16, 21, 22))::INT AS is_shoulder_hour,
      (hour IN (18, 19))::INT AS is_18_19, (hour BETWEEN 10 AND 16)::INT AS is_midday,
      (dow = 0)::INT AS is_monday, (dow = 4)::INT AS is_friday,
      (dow IN (0, 4))::INT AS is_weekend_adjacent FROM cal""",
)

register(
    "C5_hour_regime",
    shape("entity ts label block"),
    lambda s, d: S.hour_regime(
        S.hour_regime(cal(s, d)).withColumnRenamed("hour_regime", "label"), "block5"
    ).withColumnRenamed("hour_regime", "block"),
    f"""WITH {HOURLY_CAL} SELECT entity, ts, 'h' || lpad(hour::VARCHAR, 2, '0') AS label,
      CASE WHEN hour <= 5 THEN 'night_00_05' WHEN hour <= 10 THEN 'morning_06_10'
        WHEN hour <= 16 THEN 'day_11_16' WHEN hour <= 20 THEN 'peak_17_20'
        ELSE 'late_21_23' END AS block FROM cal""",
)

register(
    "C6_boundary_flags",
    shape(
        "entity ts",
        "is_month_start is_month_end is_quarter_start is_quarter_end is_year_start is_year_end",
    ),
    lambda s, d: S.boundary_flags(panels.daily(s, d)),
    f"""WITH {DAILY} SELECT entity, ts, (day(ts) = 1)::INT AS is_month_start,
      (day(ts + INTERVAL 1 DAY) = 1)::INT AS is_month_end,
      (day(ts) = 1 AND month(ts) IN (1, 4, 7, 10))::INT AS is_quarter_start,
      (day(ts + INTERVAL 1 DAY) = 1 AND month(ts) IN (3, 6, 9, 12))::INT AS is_quarter_end,
      (day(ts) = 1 AND month(ts) = 1)::INT AS is_year_start,
      (day(ts) = 31 AND month(ts) = 12)::INT AS is_year_end FROM panel""",
)

# Western Easter Sundays of the years the orders table covers, as published.
EASTERS = (
    "1992-04-19 1993-04-11 1994-04-03 1995-04-16 1996-04-07 1997-03-30 1998-04-12 1999-04-04 "
    "2000-04-23 2001-04-15 2002-03-31"
).split()
register(
    "C7_holiday_flags",
    shape("entity ts", "is_holiday is_bridge_day"),
    lambda s, d: S.holiday_flags(panels.daily(s, d)),
    f"""WITH {DAILY}, easter(d) AS (VALUES {", ".join(f"(DATE '{e}')" for e in EASTERS)}),
      years AS (SELECT DISTINCT year(ts) AS y FROM panel),
      days AS (
        SELECT make_date(y, m, d) AS day FROM years,
          (VALUES (1, 1), (5, 1), (12, 25), (12, 26)) AS fixed(m, d)
        UNION SELECT (d - INTERVAL 2 DAY)::DATE FROM easter WHERE year(d) IN (SELECT y FROM years)
        UNION SELECT (d + INTERVAL 1 DAY)::DATE FROM easter WHERE year(d) IN (SELECT y FROM years))
      SELECT entity, ts, (ts::DATE IN (SELECT day FROM days))::INT AS is_holiday,
        (ts::DATE NOT IN (SELECT day FROM days) AND isodow(ts) < 6 AND (
          (ts - INTERVAL 1 DAY)::DATE IN (SELECT day FROM days)
          OR (ts + INTERVAL 1 DAY)::DATE IN (SELECT day FROM days)))::INT AS is_bridge_day
      FROM panel""",
)

register(
    "C8_dst_flags",
    shape(
        "entity ts",
        "is_dst_start_day is_dst_end_day is_dst_transition_day dst_transition_window",
    ),
    lambda s, d: S.dst_flags(panels.daily(s, d)),
    f"""WITH {DAILY}, days AS (
        SELECT DISTINCT ts::DATE AS day FROM panel
        UNION SELECT (ts + INTERVAL 1 DAY)::DATE FROM panel
        UNION SELECT (ts - INTERVAL 1 DAY)::DATE FROM panel),
      change AS (SELECT day, month(day) AS m FROM days
        WHERE isodow(day) = 7 AND day(day) >= 25 AND month(day) IN (3, 10))
      SELECT entity, ts,
        (ts::DATE IN (SELECT day FROM change WHERE m = 3))::INT AS is_dst_start_day,
        (ts::DATE IN (SELECT day FROM change WHERE m = 10))::INT AS is_dst_end_day,
        (ts::DATE IN (SELECT day FROM change))::INT AS is_dst_transition_day,
        (ts::DATE IN (SELECT day FROM change) OR (ts - INTERVAL 1 DAY)::DATE IN (SELECT day FROM change)
          OR (ts + INTERVAL 1 DAY)::DATE IN (SELECT day FROM change))::INT AS dst_transition_window
      FROM panel""",
)

register(
    "C9_forecast_core",
    shape(
        "entity ts",
        "is_18_19 is_peak_17_20 is_night",
        "residual_load stress_ratio stress_ratio_1819 residual_load_1819 net_load_share wind_share "
        "solar_share stress_ratio_sq residual_load_sq net_load_share_peak",
    ),
    lambda s, d: S.forecast_core(S.calendar(panels.hourly(s, d))),
    f"""WITH {HOURLY_CAL}, f AS (SELECT *, (hour IN (18, 19))::INT AS is_18_19,
        (hour BETWEEN 17 AND 20)::INT AS is_peak_17_20,
        coalesce(solar_forecast <= 0, false)::INT AS is_night,
        load_forecast / (wind_forecast + 1000::DOUBLE) AS stress_ratio,
        residual_load / (load_forecast + 1e-6::DOUBLE) AS net_load_share,
        wind_forecast / (load_forecast + 1e-6::DOUBLE) AS wind_share,
        solar_forecast / (load_forecast + 1e-6::DOUBLE) AS solar_share FROM cal)
      SELECT *, stress_ratio * is_18_19 AS stress_ratio_1819,
        residual_load * is_18_19 AS residual_load_1819,
        stress_ratio * stress_ratio AS stress_ratio_sq,
        residual_load * residual_load AS residual_load_sq,
        net_load_share * is_peak_17_20 AS net_load_share_peak FROM f""",
)

register(
    "C10_system_state",
    shape(
        "entity ts",
        "is_night",
        "oversupply oversupply_pos oversupply_share oversupply_share_sq wind_share solar_share "
        "net_load_share stress_ratio residual_load_pos residual_load_neg solar_share_x_is_midday "
        "stress_x_is_peak",
    ),
    lambda s, d: S.system_state(cal(s, d)),
    f"""WITH {HOURLY_CAL}, f AS (SELECT *, greatest(load_forecast, 1e-6::DOUBLE) AS den,
        wind_forecast + solar_forecast - load_forecast AS oversupply FROM cal),
      g AS (SELECT *, CASE WHEN oversupply IS NOT NULL THEN greatest(oversupply, 0.0::DOUBLE) END AS oversupply_pos
        FROM f)
      SELECT entity, ts, coalesce(solar_forecast <= 0, false)::INT AS is_night, oversupply, oversupply_pos,
        oversupply_pos / den AS oversupply_share,
        (oversupply_pos / den) * (oversupply_pos / den) AS oversupply_share_sq,
        wind_forecast / den AS wind_share, solar_forecast / den AS solar_share,
        residual_load / den AS net_load_share,
        load_forecast / (wind_forecast + 1000::DOUBLE) AS stress_ratio,
        CASE WHEN residual_load >= 0 THEN residual_load WHEN residual_load < 0 THEN 0 END AS residual_load_pos,
        CASE WHEN residual_load <= 0 THEN -residual_load WHEN residual_load > 0 THEN 0 END AS residual_load_neg,
        solar_forecast / den * (hour BETWEEN 10 AND 16)::INT AS solar_share_x_is_midday,
        load_forecast / (wind_forecast + 1000::DOUBLE) * (hour BETWEEN 17 AND 20)::INT AS stress_x_is_peak
      FROM g""",
)

register(
    "C11_weather",
    shape(
        "entity ts",
        "",
        "gustiness_10m gust_ratio_10m ws_ratio_80_10 wind_dir_sin wind_dir_cos clear_sky_proxy "
        "diffuse_share cloud_low_share temp_dew_spread temp_apparent_gap wind80_x_residual_load "
        "wind_speed_80m_peak cloud_x_solar cloud_x_solar_day gust_ratio_floor",
    ),
    lambda s, d: S.weather(
        S.weather(S.hour_flags(met(s, d)), floor_eps=True)
        .withColumnRenamed("gust_ratio_10m", "gust_ratio_floor")
        .drop("ws_ratio_80_10")
    ),
    f"""WITH {MET}, e AS (SELECT 1e-6::DOUBLE AS eps)
      SELECT entity, ts, w1 - w2 AS gustiness_10m, w1 / (w2 + eps) AS gust_ratio_10m,
        wind_speed_80m / (w2 + eps) AS ws_ratio_80_10, sin(w1 * pi() / 180) AS wind_dir_sin,
        cos(w1 * pi() / 180) AS wind_dir_cos,
        solar_forecast / (load_forecast + eps) AS clear_sky_proxy,
        wind_forecast / (load_forecast + eps) AS diffuse_share, w2 / (w1 + eps) AS cloud_low_share,
        air_temperature_2m - w2 AS temp_dew_spread, w1 / 4 - air_temperature_2m AS temp_apparent_gap,
        wind_speed_80m * residual_load AS wind80_x_residual_load,
        wind_speed_80m * (hour BETWEEN 17 AND 20)::INT AS wind_speed_80m_peak,
        w1 * solar_forecast AS cloud_x_solar,
        w1 * solar_forecast * (solar_forecast > 0)::INT AS cloud_x_solar_day,
        CASE WHEN w2 IS NOT NULL THEN w1 / greatest(w2, eps) END AS gust_ratio_floor
      FROM met, e""",
)

register(
    "C12_turbine",
    shape(
        "entity ts",
        "ws80_bin_low ws80_bin_medium ws80_bin_high ws80_bin_cutout",
        "ws80_sq ws80_cu ws80_above_cutin ws80_above_rated ws80_below_cutin ws80_medium_cubic "
        "ws80_high_flat",
    ),
    lambda s, d: S.turbine(met(s, d)),
    f"""WITH {MET}, v AS (SELECT entity, ts, wind_speed_80m AS v FROM met)
      SELECT entity, ts, (v < 3)::INT AS ws80_bin_low, (v >= 3 AND v < 12)::INT AS ws80_bin_medium,
        (v >= 12 AND v < 25)::INT AS ws80_bin_high, (v >= 25)::INT AS ws80_bin_cutout,
        v * v AS ws80_sq, v * v * v AS ws80_cu,
        CASE WHEN v > 3 THEN v - 3 ELSE 0 END AS ws80_above_cutin,
        CASE WHEN v > 12 THEN v - 12 ELSE 0 END AS ws80_above_rated,
        CASE WHEN v < 3 THEN 3 - v ELSE 0 END AS ws80_below_cutin,
        CASE WHEN v >= 3 AND v < 12 THEN v * v * v ELSE 0 END AS ws80_medium_cubic,
        CASE WHEN v >= 12 AND v < 25 THEN 1728 ELSE 0 END AS ws80_high_flat FROM v""",
)

register(
    "C13_degree_days",
    shape("entity ts", "temp_extreme_flag", "hdd_18 cdd_22 temp_extreme_mag"),
    lambda s, d: S.degree_days(met(s, d)),
    f"""WITH {MET}, t AS (SELECT entity, ts, air_temperature_2m AS t FROM met)
      SELECT entity, ts, (t <= 2 OR t >= 28)::INT AS temp_extreme_flag,
        CASE WHEN t < 18 THEN 18 - t ELSE 0 END AS hdd_18,
        CASE WHEN t > 22 THEN t - 22 ELSE 0 END AS cdd_22,
        CASE WHEN t < 18 THEN 18 - t WHEN t > 22 THEN t - 22 ELSE 0 END AS temp_extreme_mag FROM t""",
)


def _physics(s, d):
    df = met(s, d)
    spec = SPEC.measured(df)
    df = diffs(df, spec, ["residual_load"], [6, 24])
    df = diffs(df, spec, ["wind_speed_80m"], [1])
    return S.physics(df).withColumnRenamed("wind_speed_80m_diff_1", "wind_ramp_proxy")


register(
    "C14_physics",
    shape(
        "entity ts",
        "",
        "wind_speed_80m_cubed wind_ramp_proxy residual_load_ramp_abs_6 residual_load_ramp_abs_24 "
        "cloud_regime_ratio clear_sky_error_proxy temp_gap_18 storm_score",
    ),
    _physics,
    f"""WITH {MET} SELECT entity, ts, wind_speed_80m ** 3 AS wind_speed_80m_cubed,
        wind_speed_80m - lag(wind_speed_80m) OVER w AS wind_ramp_proxy,
        abs(residual_load - lag(residual_load, 6) OVER w) AS residual_load_ramp_abs_6,
        abs(residual_load - lag(residual_load, 24) OVER w) AS residual_load_ramp_abs_24,
        wind_forecast / (solar_forecast + 1e-6::DOUBLE) AS cloud_regime_ratio,
        load_forecast - (solar_forecast + wind_forecast) AS clear_sky_error_proxy,
        abs(air_temperature_2m - 18) AS temp_gap_18, w1 * 10 / (1 + abs(w2)) AS storm_score
      FROM met WINDOW w AS (PARTITION BY entity ORDER BY ts, id)""",
)

register(
    "C15_nonlinear",
    shape(
        "entity ts",
        "",
        "net_load_abs net_load_sq wind_forecast_sq wind_forecast_cu solar_forecast_sq "
        "solar_forecast_log1p renewable_share renewable_minus_demand solar_cloud_adj temp_abs "
        "temp_apparent_abs_gap net_load_x_hour net_load_x_weekend net_load_x_morning_peak "
        "solar_x_midday wind_x_hour demand_x_renewable_share",
        3,
    ),
    lambda s, d: S.nonlinear(S.hour_flags(met(s, d))),
    f"""WITH {MET}, n AS (SELECT *, residual_load AS n, wind_forecast + solar_forecast AS renew FROM met)
      SELECT entity, ts, abs(n) AS net_load_abs, n * n AS net_load_sq,
        wind_forecast * wind_forecast AS wind_forecast_sq,
        wind_forecast * wind_forecast * wind_forecast AS wind_forecast_cu,
        solar_forecast * solar_forecast AS solar_forecast_sq,
        CASE WHEN solar_forecast IS NOT NULL THEN ln(1 + greatest(solar_forecast, 0)) END AS solar_forecast_log1p,
        renew / (abs(load_forecast) + 1e-3::DOUBLE) AS renewable_share,
        renew - load_forecast AS renewable_minus_demand,
        solar_forecast * (1 - least(greatest(w1, 0), 100) / 100) AS solar_cloud_adj,
        abs(air_temperature_2m) AS temp_abs, abs(air_temperature_2m - w1 / 4) AS temp_apparent_abs_gap,
        n * hour AS net_load_x_hour, n * (dow >= 5)::INT AS net_load_x_weekend,
        n * (hour IN (7, 8, 9))::INT AS net_load_x_morning_peak,
        solar_forecast * (hour BETWEEN 11 AND 14)::INT AS solar_x_midday,
        wind_forecast * hour AS wind_x_hour,
        load_forecast * (renew / (abs(load_forecast) + 1e-3::DOUBLE)) AS demand_x_renewable_share
      FROM n""",
)

register(
    "C16_missing_count",
    shape("entity ts", "meteo_missing_count meteo_missing_any"),
    lambda s, d: S.missing_count(
        panels.hourly(s, d), ["wind_forecast", "solar_forecast", "w1", "w2"]
    ),
    f"""WITH {HOURLY}, c AS (SELECT entity, ts, (wind_forecast IS NULL)::INT + (solar_forecast IS NULL)::INT
        + (w1 IS NULL)::INT + (w2 IS NULL)::INT AS n FROM panel)
      SELECT entity, ts, n AS meteo_missing_count, (n > 0)::INT AS meteo_missing_any FROM c""",
)

register(
    "C17_key_concat",
    shape("entity ts hour_x_entity dow_x_entity month_x_entity"),
    lambda s, d: S.key_concat(cal(s, d)),
    f"""WITH {HOURLY_CAL} SELECT entity, ts, hour::VARCHAR || '_' || entity AS hour_x_entity,
      dow::VARCHAR || '_' || entity AS dow_x_entity, month::VARCHAR || '_' || entity AS month_x_entity
      FROM cal""",
)


def _transforms(s, d):
    df = panels.events(s, d).select("id", (F.col("target") - 20.0).alias("y"))
    shift = S.shift_for_log(df, "y")
    df = df.withColumns(
        {
            "signed_log": S.target_transform("y", "signed_log"),
            "log_shift": S.target_transform("y", "log_shift", shift),
        }
    )
    return df.withColumns(
        {
            "back_signed": S.target_inverse("signed_log", "signed_log"),
            "back_shift": S.target_inverse("log_shift", "log_shift", shift),
        }
    )


register(
    "C18_target_transform",
    shape("id", "", "signed_log log_shift back_signed back_shift"),
    _transforms,
    """WITH t AS (SELECT event_id AS id, value - 20.0::DOUBLE AS y FROM events),
      m AS (SELECT CASE WHEN min(y) <= 0 THEN 1 - min(y) ELSE 0 END AS shift FROM t)
      SELECT id, sign(y) * ln(1 + abs(y)) AS signed_log, ln(y + shift) AS log_shift,
        y AS back_signed, y AS back_shift FROM t, m""",
)


def _yeo_johnson(s, d):
    df = panels.events(s, d).select("id", (F.col("target") - 20.0).alias("y"))
    lam = S.fit_yeo_johnson(df, "y")
    df = df.withColumn("z", S.yeo_johnson("y", lam)).withColumn("lambda", F.lit(lam))
    return df.withColumn("back", S.yeo_johnson_inverse("z", lam))


register(
    "C19_yeo_johnson",
    shape("id", "", "lambda z back", 5),
    _yeo_johnson,
    """WITH t AS (SELECT event_id AS id, value - 20.0::DOUBLE AS y FROM events),
      grid AS (SELECT i / 10.0::DOUBLE AS lam FROM range(-20, 41) AS r(i)),
      z AS (SELECT lam, id, y, CASE
          WHEN y >= 0 AND lam = 0 THEN ln(1 + y)
          WHEN y >= 0 THEN ((y + 1) ** lam - 1) / lam
          WHEN lam = 2 THEN -ln(1 - y)
          ELSE -((1 - y) ** (2 - lam) - 1) / (2 - lam) END AS z FROM t, grid),
      ll AS (SELECT lam, -count(*) / 2.0::DOUBLE * ln(var_pop(z))
          + (lam - 1) * sum(sign(y) * ln(1 + abs(y))) AS ll FROM z GROUP BY lam)
      SELECT id, lam AS "lambda", z, y AS back FROM z
      WHERE lam = (SELECT arg_max(lam, ll) FROM ll)""",
)


def _yeo_johnson_fitted(s, d):
    df = panels.events(s, d).select("id", (F.col("target") - 20.0).alias("y"))
    lam = S.fit_yeo_johnson(df, "y", tol=1e-4)
    return df.withColumn("z", S.yeo_johnson("y", lam)).withColumn("lambda", F.lit(lam))


def _rounds(n: int) -> str:
    """Rounds of probes around the best value so far, each a sixteenth of the width before."""
    z = """CASE WHEN y >= 0 AND abs(lam) < 1e-9 THEN ln(1 + y) WHEN y >= 0 THEN ((y + 1) ** lam - 1) / lam
          WHEN abs(2 - lam) < 1e-9 THEN -ln(1 - y) ELSE -((1 - y) ** (2 - lam) - 1) / (2 - lam) END"""
    out = []
    for i in range(n + 1):
        probes = (
            "SELECT i / 10.0::DOUBLE AS lam FROM range(-20, 41) AS r(i)" if i == 0
            else f"SELECT best - {0.1 / 8 ** (i - 1)!r}::DOUBLE + {0.2 / 16 / 8 ** (i - 1)!r}::DOUBLE * i AS lam FROM b{i - 1}, range(17) AS r(i)"
        )
        out.append(f"""p{i} AS ({probes}), b{i} AS (SELECT arg_max(lam, ll) AS best FROM (
          SELECT lam, -count(*) / 2.0::DOUBLE * ln(var_pop({z})) + (lam - 1) * sum(sign(y) * ln(1 + abs(y))) AS ll
          FROM t, p{i} GROUP BY lam))""")
    return ",\n      ".join(out) + f",\n      last AS (SELECT id, best AS lam, y FROM t, b{n}), z AS (SELECT id, lam, {z} AS z FROM last)"


register(
    "C19_yeo_johnson_fitted",
    shape("id", "", "lambda z", 4),
    _yeo_johnson_fitted,
    f"""WITH t AS (SELECT event_id AS id, value - 20.0::DOUBLE AS y FROM events),
      {_rounds(4)} SELECT id, lam AS "lambda", z FROM z""",
)
