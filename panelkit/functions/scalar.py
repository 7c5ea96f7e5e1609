"""Row-wise feature projections. Each returns ``df`` with added columns, skipping a feature
whose input columns are absent, and stays a plain projection (no shuffle, no Python)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import (
    clip,
    flag,
    has,
    num,
    positive,
    ratio,
    ratio_floor,
    wall_clock,
)
from panelkit.plans.layout import attach, scalars

# The hour sets and season months of the reference features.
MORNING_PEAK = (7, 8, 9)
EVENING_PEAK = (17, 18, 19, 20)
LATE_PEAK = (18, 19)
NIGHT_BLOCK = (0, 1, 2, 3, 4, 5)
MIDDAY = (10, 11, 12, 13, 14, 15, 16)
MIDDAY_SOLAR = (11, 12, 13, 14)
SHOULDER = (6, 10, 15, 16, 21, 22)
WINTER = (11, 12, 1, 2, 3)
# Upper hour (inclusive) and label of the five hour blocks.
HOUR_BLOCKS = (
    (5, "night_00_05"),
    (10, "morning_06_10"),
    (16, "day_11_16"),
    (20, "peak_17_20"),
    (23, "late_21_23"),
)
# Month and day of the fixed public holidays.
FIXED_HOLIDAYS = ((1, 1), (5, 1), (12, 25), (12, 26))
# Three marked days for each of six holidays over five thousand years: a bound on that table.
MAX_MARKED_DAYS = 3 * 6 * 5_000


def calendar(df: DataFrame, ts: str = "ts", winter: Sequence[int] = WINTER) -> DataFrame:
    """hour, dow (Monday 0), day, month, ISO week, weekend and winter flags."""
    t = F.col(ts)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "dow": F.weekday(t),
            "day": F.dayofmonth(t),
            "month": F.month(t),
            "weekofyear": F.weekofyear(t),
            "is_weekend": flag(F.weekday(t) >= 5),
            "is_winter": flag(F.month(t).isin(*winter)),
        }
    )


def harmonics(df: DataFrame, c: str, period: float, ks: Iterable[int] = (1, 2, 3)) -> DataFrame:
    """sin and cos of k full turns per ``period``."""
    turn = F.col(c) / F.lit(float(period))
    return df.withColumns(
        {
            f"{c}_{name}_{k}": fn(F.lit(2.0 * math.pi * k) * turn)
            for k in ks
            for name, fn in (("sin", F.sin), ("cos", F.cos))
        }
    )


def year_harmonics(df: DataFrame, ts: str = "ts") -> DataFrame:
    return (
        harmonics(df.withColumn("__doy", F.dayofyear(ts)), "__doy", 365.25, (1,))
        .withColumnsRenamed({"__doy_sin_1": "doy_sin", "__doy_cos_1": "doy_cos"})
        .drop("__doy")
    )


def duration(df: DataFrame, start: str, end: str) -> DataFrame:
    """Hours between two wall-clock times and the start in epoch seconds."""
    epoch = wall_clock("1970-01-01")
    return df.withColumns(
        {
            "duration_hours": F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
            / F.lit(3.6e9),
            f"{start}_epoch": F.timestamp_diff("SECOND", epoch, F.col(start)),
        }
    )


def hour_flags(df: DataFrame, sets: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """0/1 flags of hour sets and of Monday / Friday."""
    sets = sets or {
        "is_morning_peak": MORNING_PEAK,
        "is_evening_peak": EVENING_PEAK,
        "is_night_block": NIGHT_BLOCK,
        "is_midday_solar": MIDDAY_SOLAR,
        "is_shoulder_hour": SHOULDER,
        "is_18_19": LATE_PEAK,
        "is_peak_17_20": EVENING_PEAK,
        "is_midday": MIDDAY,
    }
    cols = {name: flag(F.col("hour").isin(*hours)) for name, hours in sets.items()}
    if has(df, "dow"):
        cols |= {
            "is_monday": flag(F.col("dow") == 0),
            "is_friday": flag(F.col("dow") == 4),
            "is_weekend_adjacent": flag(F.col("dow").isin(0, 4)),
        }
    return df.withColumns(cols)


def hour_regime(df: DataFrame, mode: str = "hour", blocks=HOUR_BLOCKS) -> DataFrame:
    """Label of the hour: ``hNN`` or the name of its block; ``h_na`` where it is missing."""
    h = F.col("hour")
    if mode == "hour":
        label = F.format_string("h%02d", h)
    elif mode == "block5":
        label = F.lit(None).cast("string")
        for upper, name in reversed(blocks):
            label = F.when(h <= upper, F.lit(name)).otherwise(label)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn("hour_regime", F.when(h.between(0, 23), label).otherwise(F.lit("h_na")))


def boundary_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First / last day of month, quarter and year."""
    d = F.to_date(ts)
    month_end = d == F.last_day(d)
    return df.withColumns(
        {
            "is_month_start": flag(F.dayofmonth(d) == 1),
            "is_month_end": flag(month_end),
            "is_quarter_start": flag(d == F.trunc(d, "quarter")),
            "is_quarter_end": flag(month_end & (F.month(d) % 3 == 0)),
            "is_year_start": flag(F.dayofyear(d) == 1),
            "is_year_end": flag(month_end & (F.month(d) == 12)),
        }
    )


def easter_sunday(year: Column) -> Column:
    """Date of Western Easter by the anonymous Gregorian computus, as integer arithmetic."""

    def whole(x: Column, n: int) -> Column:
        return F.floor(x / F.lit(n))

    a = F.pmod(year, F.lit(19))
    century, of = whole(year, 100), F.pmod(year, F.lit(100))
    lift = whole(century - whole(century + 8, 25) + 1, 3)
    moon = F.pmod(19 * a + century - whole(century, 4) - lift + 15, F.lit(30))
    week = F.pmod(
        32 + 2 * F.pmod(century, F.lit(4)) + 2 * whole(of, 4) - moon - F.pmod(of, F.lit(4)),
        F.lit(7),
    )
    shift = whole(a + 11 * moon + 22 * week, 451)
    n = moon + week - 7 * shift + 114
    return F.make_date(
        year.cast("int"), whole(n, 31).cast("int"), (F.pmod(n, F.lit(31)) + 1).cast("int")
    )


def holidays(years: DataFrame, fixed=FIXED_HOLIDAYS) -> DataFrame:
    """One row per holiday (``day``) of the given distinct years (``year``)."""
    easter = easter_sunday(F.col("year"))
    days = [F.make_date(F.col("year"), F.lit(m), F.lit(d)) for m, d in fixed]
    days += [F.date_sub(easter, 2), F.date_add(easter, 1)]
    return years.select(F.explode(F.array(*days)).alias("day"))


def holiday_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Holiday flag, and bridge day: a weekday next to a holiday that is not one itself.

    Only holidays of years that occur in the data are known.
    """
    years = df.select(F.year(ts).alias("year")).filter(F.col("year").isNotNull()).distinct()
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")
    marked = (
        holidays(years)
        .select("day", step)
        .groupBy(F.date_add("day", F.col("step")).alias("__day"))
        .agg(
            F.max((F.col("step") == 0).cast("int")).alias("__on"),
            F.max((F.col("step") != 0).cast("int")).alias("__near"),
        )
    )
    out = attach(df.withColumn("__day", F.to_date(ts)), marked, ["__day"], MAX_MARKED_DAYS)
    on = F.coalesce("__on", F.lit(0))
    weekday = F.weekday("__day") < 5
    return out.withColumns(
        {
            "is_holiday": on,
            "is_bridge_day": flag((on == 0) & (F.col("__near") == 1) & weekday),
        }
    ).drop("__day", "__on", "__near")


def _last_sunday(day: Column, month: int) -> Column:
    end = F.last_day(F.make_date(F.year(day), F.lit(month), F.lit(1)))
    return F.date_sub(end, F.pmod(F.weekday(end) + 1, F.lit(7)))


def dst_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    """EU clock-change days (last Sunday of March / October) and the day either side."""
    day = F.to_date(ts)
    start, end = day == _last_sunday(day, 3), day == _last_sunday(day, 10)

    def change(d: Column) -> Column:
        return (d == _last_sunday(d, 3)) | (d == _last_sunday(d, 10))

    near = change(day) | change(F.date_sub(day, 1)) | change(F.date_add(day, 1))
    return df.withColumns(
        {
            "is_dst_start_day": flag(start),
            "is_dst_end_day": flag(end),
            "is_dst_transition_day": flag(start | end),
            "dst_transition_window": flag(near),
        }
    )


def residual_load(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "residual_load",
        F.col("load_forecast") - F.col("wind_forecast") - F.col("solar_forecast"),
    )


def forecast_core(df: DataFrame) -> DataFrame:
    """Residual load, shares, stress ratio, squares and peak-hour interactions."""
    df = residual_load(df).withColumns(
        {
            "is_18_19": flag(F.col("hour").isin(*LATE_PEAK)),
            "is_peak_17_20": flag(F.col("hour").isin(*EVENING_PEAK)),
            "is_night": flag(F.col("solar_forecast") <= 0.0),
            "stress_ratio": ratio("load_forecast", "wind_forecast", 1000.0),
            "wind_share": ratio("wind_forecast", "load_forecast"),
            "solar_share": ratio("solar_forecast", "load_forecast"),
            "net_load_share": ratio("residual_load", "load_forecast"),
        }
    )
    s, r = F.col("stress_ratio"), F.col("residual_load")
    return df.withColumns(
        {
            "stress_ratio_1819": s * F.col("is_18_19"),
            "residual_load_1819": r * F.col("is_18_19"),
            "stress_ratio_sq": s * s,
            "residual_load_sq": r * r,
            "net_load_share_peak": F.col("net_load_share") * F.col("is_peak_17_20"),
        }
    )


def system_state(df: DataFrame) -> DataFrame:
    """Oversupply, its positive part and shares over max(load, eps)."""
    load, wind, solar = (F.col(f"{c}_forecast") for c in ("load", "wind", "solar"))
    df = df.withColumns(
        {
            "residual_load": load - wind - solar,
            "oversupply": (wind + solar) - load,
            "wind_share": ratio_floor(wind, load),
            "solar_share": ratio_floor(solar, load),
            "stress_ratio": ratio(load, wind, 1000.0),
            "is_midday": flag(F.col("hour").isin(*MIDDAY)),
            "is_peak_17_20": flag(F.col("hour").isin(*EVENING_PEAK)),
            "is_night": flag(solar <= 0),
        }
    )
    over = positive("oversupply")
    r = F.col("residual_load")
    share = ratio_floor(over, load)
    return df.withColumns(
        {
            "oversupply_pos": over,
            "oversupply_share": share,
            "oversupply_share_sq": share * share,
            "net_load_share": ratio_floor(r, load),
            "residual_load_sq": r * r,
            "stress_ratio_sq": F.col("stress_ratio") * F.col("stress_ratio"),
            "residual_load_pos": positive(r),
            "residual_load_neg": positive(-r),
            "solar_share_x_is_midday": F.col("solar_share") * F.col("is_midday"),
            "stress_x_is_peak": F.col("stress_ratio") * F.col("is_peak_17_20"),
        }
    )


def weather(df: DataFrame, floor_eps: bool = False) -> DataFrame:
    """Gustiness, ratios, direction, clear-sky proxy, spreads and products.

    ``floor_eps`` divides by max(y, eps) instead of y + eps.
    """
    div = ratio_floor if floor_eps else ratio
    c = F.col
    table = {
        "gustiness_10m": (
            ("wind_gust_speed_10m", "wind_speed_10m"),
            lambda: c("wind_gust_speed_10m") - c("wind_speed_10m"),
        ),
        "gust_ratio_10m": (
            ("wind_gust_speed_10m", "wind_speed_10m"),
            lambda: div("wind_gust_speed_10m", "wind_speed_10m"),
        ),
        "ws_ratio_80_10": (
            ("wind_speed_80m", "wind_speed_10m"),
            lambda: div("wind_speed_80m", "wind_speed_10m"),
        ),
        "wind_dir_sin": (
            ("wind_direction_80m",),
            lambda: F.sin(F.radians("wind_direction_80m")),
        ),
        "wind_dir_cos": (
            ("wind_direction_80m",),
            lambda: F.cos(F.radians("wind_direction_80m")),
        ),
        "clear_sky_proxy": (
            ("direct_normal_irradiance", "global_horizontal_irradiance"),
            lambda: div("direct_normal_irradiance", "global_horizontal_irradiance"),
        ),
        "diffuse_share": (
            ("diffuse_horizontal_irradiance", "global_horizontal_irradiance"),
            lambda: div("diffuse_horizontal_irradiance", "global_horizontal_irradiance"),
        ),
        "cloud_low_share": (
            ("cloud_cover_low", "cloud_cover_total"),
            lambda: div("cloud_cover_low", "cloud_cover_total"),
        ),
        "temp_dew_spread": (
            ("air_temperature_2m", "dew_point_temperature_2m"),
            lambda: c("air_temperature_2m") - c("dew_point_temperature_2m"),
        ),
        "temp_apparent_gap": (
            ("apparent_temperature_2m", "air_temperature_2m"),
            lambda: c("apparent_temperature_2m") - c("air_temperature_2m"),
        ),
        "wind80_x_residual_load": (
            ("wind_speed_80m", "residual_load"),
            lambda: c("wind_speed_80m") * c("residual_load"),
        ),
        "wind_speed_80m_peak": (
            ("wind_speed_80m", "is_peak_17_20"),
            lambda: c("wind_speed_80m") * c("is_peak_17_20"),
        ),
        "cloud_x_solar": (
            ("cloud_cover_total", "solar_forecast"),
            lambda: c("cloud_cover_total") * c("solar_forecast"),
        ),
        "cloud_x_solar_day": (
            ("cloud_cover_total", "solar_forecast"),
            lambda: c("cloud_cover_total")
            * c("solar_forecast")
            * flag(c("solar_forecast") > 0.0),
        ),
    }
    return df.withColumns({k: make() for k, (needs, make) in table.items() if has(df, *needs)})


def turbine(df: DataFrame, c: str = "wind_speed_80m", prefix: str = "ws80") -> DataFrame:
    """Power-curve pieces: powers, speed bins, distance to cut-in and rated speed."""
    v = F.col(c)
    cube = v * v * v
    medium, high = flag((v >= 3.0) & (v < 12.0)), flag((v >= 12.0) & (v < 25.0))
    return df.withColumns(
        {
            f"{prefix}_sq": v * v,
            f"{prefix}_cu": cube,
            f"{prefix}_bin_low": flag(v < 3.0),
            f"{prefix}_bin_medium": medium,
            f"{prefix}_bin_high": high,
            f"{prefix}_bin_cutout": flag(v >= 25.0),
            f"{prefix}_above_cutin": positive(v - 3.0),
            f"{prefix}_above_rated": positive(v - 12.0),
            f"{prefix}_below_cutin": positive(3.0 - v),
            f"{prefix}_medium_cubic": medium * cube,
            f"{prefix}_high_flat": high * F.lit(12.0**3),
        }
    )


def degree_days(df: DataFrame, c: str = "air_temperature_2m") -> DataFrame:
    """Heating (18) and cooling (22) degrees, their sum, and the extreme flag."""
    t = F.col(c)
    hdd, cdd = positive(18.0 - t), positive(t - 22.0)
    return df.withColumns(
        {
            "hdd_18": hdd,
            "cdd_22": cdd,
            "temp_extreme_mag": hdd + cdd,
            "temp_extreme_flag": flag((t <= 2.0) | (t >= 28.0)),
        }
    )


def physics(df: DataFrame, cape: str = "convective_available_potential_energy") -> DataFrame:
    """Cubed wind, ramp magnitudes, cloud ratio, clear-sky error, temperature gap, storm score.

    The wind ramp itself is a lag difference (``diffs``) and is taken from ``df`` if present.
    """
    c = F.col
    out: dict[str, Column] = {}
    if has(df, "wind_speed_80m"):
        v = c("wind_speed_80m")
        out["wind_speed_80m_cubed"] = v * v * v
    for k in (6, 24):
        if has(df, f"residual_load_diff_{k}"):
            out[f"residual_load_ramp_abs_{k}"] = F.abs(c(f"residual_load_diff_{k}"))
    diffuse, direct = "diffuse_horizontal_irradiance", "direct_normal_irradiance"
    if has(df, diffuse, direct):
        out["cloud_regime_ratio"] = ratio(diffuse, direct)
    if has(df, diffuse, direct, "global_horizontal_irradiance"):
        out["clear_sky_error_proxy"] = c("global_horizontal_irradiance") - (
            c(direct) + c(diffuse)
        )
    if has(df, "air_temperature_2m"):
        out["temp_gap_18"] = F.abs(c("air_temperature_2m") - 18.0)
    if has(df, cape, "convective_inhibition"):
        out["storm_score"] = c(cape) / (1.0 + F.abs(c("convective_inhibition")))
    return df.withColumns(out)


def nonlinear(df: DataFrame, load: str = "load_forecast", net: str = "net_load") -> DataFrame:
    """Convex transforms of load, wind and solar, and their interactions."""
    c = F.col
    demand, wind, solar = c(load), c("wind_forecast"), c("solar_forecast")
    if not has(df, net):
        df = df.withColumn(net, demand - wind - solar)
    n, renew = c(net), wind + solar
    share = renew / (F.abs(demand) + F.lit(1e-3))
    out = {
        f"{net}_abs": F.abs(n),
        f"{net}_sq": n * n,
        "wind_forecast_sq": wind * wind,
        "wind_forecast_cu": wind * wind * wind,
        "solar_forecast_sq": solar * solar,
        "solar_forecast_log1p": F.log1p(positive(solar)),
        "renewable_share": share,
        "renewable_minus_demand": renew - demand,
        "demand_minus_wind": demand - wind,
        "demand_minus_solar": demand - solar,
        "wind_minus_solar": wind - solar,
        "demand_x_renewable_share": demand * share,
    }
    if has(df, "cloud_cover_total"):
        out["solar_cloud_adj"] = solar * (1.0 - clip("cloud_cover_total", 0.0, 100.0) / 100.0)
    if has(df, "air_temperature_2m", "apparent_temperature_2m"):
        out["temp_abs"] = F.abs("air_temperature_2m")
        out["temp_apparent_abs_gap"] = F.abs(
            c("air_temperature_2m") - c("apparent_temperature_2m")
        )
    if has(df, "hour"):
        out |= {
            f"{net}_x_hour": n * c("hour"),
            "solar_x_hour": solar * c("hour"),
            "wind_x_hour": wind * c("hour"),
        }
    for f in ("is_weekend", "is_morning_peak", "is_evening_peak", "is_weekend_adjacent"):
        if has(df, f):
            out[f"{net}_x_{f.removeprefix('is_')}"] = n * c(f)
    if has(df, "is_midday_solar"):
        out["solar_x_midday"] = solar * c("is_midday_solar")
    return df.withColumns(out)


def missing_count(df: DataFrame, cols: Sequence[str], prefix: str = "meteo_missing") -> DataFrame:
    """Number of NULLs per row among ``cols``, and whether there is any."""
    n = F.lit(0)
    for c in cols:
        n = n + F.col(c).isNull().cast("int")
    return df.withColumns({f"{prefix}_count": n, f"{prefix}_any": flag(n > 0)})


def key_concat(
    df: DataFrame, entity: str = "entity", parts: Sequence[str] = ("hour", "dow", "month")
) -> DataFrame:
    """Composite keys such as ``hour_x_market``: calendar part and entity joined by ``_``."""
    return df.withColumns(
        {f"{p}_x_{entity}": F.concat_ws("_", F.col(p).cast("string"), F.col(entity)) for p in parts}
    )


# --- target transforms ---------------------------------------------------------------------


def shift_for_log(train: DataFrame, c: str) -> Column:
    """Shift that makes 1 the smallest training value when there are values <= 0, else 0."""
    low = scalars(train, F.min(c).alias("low"))["low"]
    return F.when(low <= 0, 1.0 - low).otherwise(F.lit(0.0))


def target_transform(c: Column | str, method: str, shift: Column | float = 0.0) -> Column:
    y = num(c)
    if method == "none":
        return y
    if method == "signed_log":
        return F.signum(y) * F.log1p(F.abs(y))
    if method == "log_shift":
        return F.ln(y + num(shift))
    raise ValueError(f"unknown transform: {method}")


def target_inverse(c: Column | str, method: str, shift: Column | float = 0.0) -> Column:
    z = num(c)
    if method == "none":
        return z
    if method == "signed_log":
        return F.signum(z) * F.expm1(F.abs(z))
    if method == "log_shift":
        return F.exp(z) - num(shift)
    raise ValueError(f"unknown transform: {method}")


def yeo_johnson(c: Column | str, lam: float) -> Column:
    """Power transform that is defined on both sides of zero."""
    y = num(c)
    up = F.log1p(y) if abs(lam) < 1e-9 else (F.pow(y + 1.0, F.lit(lam)) - 1.0) / lam
    rest = 2.0 - lam
    down = -F.log1p(-y) if abs(rest) < 1e-9 else -(F.pow(1.0 - y, F.lit(rest)) - 1.0) / rest
    return F.when(y >= 0, up).when(y < 0, down)


def yeo_johnson_inverse(c: Column | str, lam: float) -> Column:
    z = num(c)
    up = F.expm1(z) if abs(lam) < 1e-9 else F.pow(z * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    rest = 2.0 - lam
    down = -F.expm1(-z) if abs(rest) < 1e-9 else 1.0 - F.pow(1.0 - rest * z, F.lit(1.0 / rest))
    return F.when(z >= 0, up).when(z < 0, down)


#: Probes of a round in which the transform's power is narrowed down, besides the first.
PROBES = 16


def fit_yeo_johnson(
    train: DataFrame, c: str, grid: Sequence[float] | None = None, tol: float | None = None
) -> float:
    """Grid value with the largest normal log-likelihood; one aggregate over the data.

    With ``tol`` the search goes on between the neighbours of the best grid value: a round tries evenly spaced
    values in one aggregate and keeps the steps around the best, until a step is no longer than ``tol``."""
    grid = [i / 10 for i in range(-20, 41)] if grid is None else sorted(grid)
    best = _likeliest(train, c, grid)
    if tol is not None and len(grid) > 1:
        at = grid.index(best)
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        step = high - low
        while step > tol:
            step = (high - low) / PROBES
            best = _likeliest(train, c, [low + step * i for i in range(PROBES + 1)])
            low, high = best - step, best + step
    return best


def _likeliest(train: DataFrame, c: str, grid: Sequence[float]) -> float:
    y = F.col(c)
    terms = [F.var_pop(yeo_johnson(y, lam)).alias(f"v{i}") for i, lam in enumerate(grid)]
    jac = F.sum(F.signum(y) * F.log1p(F.abs(y))).alias("jac")
    row = train.agg(F.count(y).alias("n"), jac, *terms).first()
    best, best_ll = 1.0, -math.inf
    for i, lam in enumerate(grid):
        var = row[f"v{i}"]
        if not var or var <= 0 or math.isnan(var):
            continue
        ll = -row["n"] / 2 * math.log(var) + (lam - 1.0) * row["jac"]
        if ll > best_ll:
            best, best_ll = lam, ll
    return best


