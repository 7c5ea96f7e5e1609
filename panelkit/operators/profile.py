"""Statistics fitted on training rows and applied to any rows (fit / apply pairs).

A fit returns a small table keyed by entity or cell; applying it is a left join on null-safe
keys, broadcast only when the spec has proven the table small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import clip, flag, has, positive, truth
from panelkit.functions.scalar import EVENING_PEAK, LATE_PEAK, MIDDAY
from panelkit.operators.window import expanding_prev
from panelkit.plans.layout import PanelSpec, attach, row_scalars, scalars
from panelkit.plans.ranks import finite, quantiles, weight_below
from panelkit.sources.io import materialize

# Proven size of the calendar part of a cell key.
CELL_SIZE = {"hour": 25, "dow": 8, "month": 13}


def table_bound(spec: PanelSpec, keys: Sequence[str]) -> int | None:
    """Proven row bound of a table keyed by ``keys``, or None."""
    n = 1
    rest = [k for k in keys if k != spec.entity]
    for k in rest:
        if k not in CELL_SIZE:
            return None
        n *= CELL_SIZE[k]
    return spec.table_rows(n) if spec.entity in keys else n


def join_table(df: DataFrame, table: DataFrame, keys: Sequence[str], spec: PanelSpec) -> DataFrame:
    return attach(df, table, keys, table_bound(spec, keys))


def scopes(spec: PanelSpec) -> dict[str, list[str]]:
    """Cell keys by the short names used in profile columns."""
    e = spec.entity
    return {"mhd": [e, "hour", "dow"], "mh": [e, "hour"], "m": [e]}


def summarize(
    df: DataFrame,
    by: Sequence[str],
    aggs: Mapping[str, Column],
    wanted: Mapping[str, tuple[Column | str, float]],
    spec: PanelSpec,
) -> DataFrame:
    """Aggregates and exact quantiles of the same groups; NaN and infinity are in no quantile."""
    by = list(by)
    if spec.bounded(by):
        qs = {a: F.percentile(finite(c), F.lit(float(q))) for a, (c, q) in wanted.items()}
        return df.groupBy(*by).agg(*[e.alias(a) for a, e in {**aggs, **qs}.items()])
    base = df.groupBy(*by).agg(*[e.alias(a) for a, e in aggs.items()])
    if not wanted:
        return base
    table = quantiles(df, by, wanted, spec)
    if by:
        return attach(base, table, by, table_bound(spec, by))
    return base.withColumns(row_scalars(table))


# --- profiles ------------------------------------------------------------------------------


def profile(train: DataFrame, keys: Sequence[str], prefix: str, c: str = "target") -> DataFrame:
    """Mean, sample std and count of ``c`` per group."""
    return train.groupBy(*keys).agg(
        F.avg(c).alias(f"{prefix}_mean"),
        F.stddev_samp(c).alias(f"{prefix}_std"),
        F.count(c).alias(f"{prefix}_count"),
    )


def profiles(
    train: DataFrame, df: DataFrame, spec: PanelSpec, c: str = "target", prefix: str = "profile"
) -> DataFrame:
    """Attach the three profile levels. They include a training row's own target, so on
    training rows they leak; ``expanding_prev`` / ``dynamic_profile`` do not."""
    finest = None
    for name, keys in scopes(spec).items():
        if finest is None:
            table = finest = profile_sums(train, keys, c)
        else:
            table = merge_profiles(finest, keys)
        df = join_table(df, named_profile(table, keys, f"{prefix}_{name}"), keys, spec)
    return df


def profile_sums(train: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Count, mean and squared deviations per group: enough to derive every coarser level."""
    n = F.count(c)
    return train.groupBy(*keys).agg(
        n.alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * n).alias("dev")
    )


def merge_profiles(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coarser level of a ``profile_sums`` table, so the rows themselves are read only once.

    The deviations of the means are taken around the group's mean, which does not cancel."""
    group = W.partitionBy(*keys)
    n, mean = F.col("n"), F.col("mean")
    whole = F.try_divide(F.sum(n * mean).over(group), F.sum(n).over(group))
    shifted = table.withColumn("__whole", whole)
    gap = mean - F.col("__whole")
    return shifted.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.max("__whole").alias("mean"),
        F.sum(F.col("dev") + n * gap * gap).alias("dev"),
    )


def named_profile(table: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    n = F.col("n")
    return table.select(
        *keys,
        F.col("mean").alias(f"{prefix}_mean"),
        F.when(n > 1, F.sqrt(F.col("dev") / (n - 1))).alias(f"{prefix}_std"),
        n.alias(f"{prefix}_count"),
    )


def winsor_bounds(
    train: DataFrame,
    spec: PanelSpec,
    lo: float = 0.01,
    hi: float = 0.99,
    min_rows: int = 24,
    c: str = "target",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quantile bounds by (entity, hour), by entity and overall (one row)."""
    want = {"lo": (c, lo), "hi": (c, hi)}
    e = spec.entity
    cell = summarize(train, [e, "hour"], {"n": F.count(F.lit(1))}, want, spec)
    cell = cell.filter(F.col("n") >= min_rows)
    return (
        cell.select(e, "hour", F.col("lo").alias("lo_mh"), F.col("hi").alias("hi_mh")),
        quantiles(train, [e], {"lo_m": (c, lo), "hi_m": (c, hi)}, spec),
        quantiles(train, [], {"lo_g": (c, lo), "hi_g": (c, hi)}, spec),
    )


def winsorize(
    df: DataFrame, bounds: tuple[DataFrame, DataFrame, DataFrame], spec: PanelSpec, c: str, out: str
) -> DataFrame:
    cell, entity, overall = bounds
    g = row_scalars(overall)
    keys = [spec.entity, "hour"]
    df = join_table(join_table(df, cell, keys, spec), entity, [spec.entity], spec)
    lo = F.coalesce("lo_mh", "lo_m", g["lo_g"])
    hi = F.greatest(F.coalesce("hi_mh", "hi_m", g["hi_g"]), lo)
    return df.withColumn(out, clip(c, lo, hi)).drop("lo_mh", "hi_mh", "lo_m", "hi_m")


def backoff(df: DataFrame, overall: Mapping[str, Column], prefix: str = "profile") -> DataFrame:
    """Fill missing mean / std: cell from (entity, hour), that from entity, that from overall."""
    p = prefix
    for level, wider in (("m", None), ("mh", "m"), ("mhd", "mh")):
        df = df.withColumns(
            {
                f"{p}_{level}_{s}": F.coalesce(
                    F.col(f"{p}_{level}_{s}"),
                    overall[s] if wider is None else F.col(f"{p}_{wider}_{s}"),
                )
                for s in ("mean", "std")
            }
        )
    return df.withColumns(
        {f"{p}_{x}_count": F.coalesce(f"{p}_{x}_count", F.lit(0)) for x in ("m", "mh", "mhd")}
    )


def overall_stats(train: DataFrame, c: str = "target") -> dict[str, Column]:
    return scalars(
        train, F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")
    )


def shrink(
    df: DataFrame, alpha_mhd: float = 24.0, alpha_m: float = 24.0, prefix: str = "profile"
) -> DataFrame:
    """Count-weighted blending of levels, w = n / (n + alpha).

    The cell moves toward (entity, hour) when it is rare; the entity moves toward
    (entity, hour) as that one gets common; (entity, hour) itself is left as it is.
    """
    p, zero = prefix, F.lit(0.0)
    n_mhd, n_mh = F.col(f"{p}_mhd_count"), F.col(f"{p}_mh_count")
    w_mhd = n_mhd / (n_mhd + F.lit(max(alpha_mhd, 1e-6)))
    w_mh = n_mh / (n_mh + F.lit(max(alpha_m, 1e-6)))
    out = {}
    for s in ("mean", "std"):
        m, mh, mhd = (F.col(f"{p}_{x}_{s}") for x in ("m", "mh", "mhd"))
        cell, entity = w_mhd * mhd + (1.0 - w_mhd) * mh, (1.0 - w_mh) * m + w_mh * mh
        out[f"{p}_mhd_{s}"] = cell if s == "mean" else clip(cell, low=zero)
        out[f"{p}_m_{s}"] = entity if s == "mean" else clip(entity, low=zero)
    return df.withColumns(out)


def dynamic_profile(
    train: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    prefix: str,
    spec: PanelSpec,
    c: str = "target",
) -> tuple[DataFrame, DataFrame]:
    """Past-only profile for training rows, full-history profile for test rows.

    The std is a population one on training rows and a sample one on test rows, and only the
    training count includes missing targets.
    """
    past = expanding_prev(train, spec, keys, c, prefix)
    y = F.col(c)
    full = train.groupBy(*keys).agg(
        F.count(c).cast("double").alias(f"{prefix}_dyn_count"),
        F.avg(c).alias(f"{prefix}_dyn_mean"),
        F.stddev_samp(c).alias(f"{prefix}_dyn_std"),
        F.avg(y * y).alias(f"{prefix}_dyn_sq_mean"),
    )
    full = full.withColumn(f"{prefix}_dyn_rms", F.sqrt(f"{prefix}_dyn_sq_mean"))
    return past, join_table(test, full, keys, spec)


def baseline_deviation(
    train: DataFrame, df: DataFrame, cols: Sequence[str], keys: Sequence[str], spec: PanelSpec
) -> DataFrame:
    """Distance and z of each column to its training cell mean; a missing std counts as 0."""
    stats = train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mhd_mean") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_mhd_std") for c in cols],
    )
    out = join_table(df, stats, keys, spec)
    made = {}
    for c in cols:
        delta = F.col(c) - F.col(f"{c}_mhd_mean")
        made[f"{c}_mhd_delta"] = delta
        made[f"{c}_mhd_z"] = delta / (F.coalesce(f"{c}_mhd_std", F.lit(0.0)) + 1e-3)
    return out.withColumns(made)


# --- quantile based ------------------------------------------------------------------------


def quantile_regimes(train: DataFrame, df: DataFrame, c: str, spec: PanelSpec) -> DataFrame:
    """Low / high / mid-high flags of each entity's q10, q90, q75, and tail distances."""
    t = quantiles(
        train, [spec.entity], {"__q10": (c, 0.1), "__q90": (c, 0.9), "__q75": (c, 0.75)}, spec
    )
    x = F.col(c)
    return (
        join_table(df, t, [spec.entity], spec)
        .withColumns(
            {
                f"is_low_{c}_regime": flag(x <= F.col("__q10")),
                f"is_high_{c}_regime": flag(x >= F.col("__q90")),
                f"is_mid_high_{c}": flag(x >= F.col("__q75")),
                f"{c}_tail_up": positive(x - F.col("__q90")),
                f"{c}_tail_down": positive(F.col("__q10") - x),
            }
        )
        .drop("__q10", "__q90", "__q75")
    )


def empirical_pctl(train: DataFrame, df: DataFrame, c: str, spec: PanelSpec) -> DataFrame:
    """Mid-rank of each value among its entity's training values, over n - 1 (so the top
    value exceeds 1), and a flag from 0.8 up. An entity without training rows gets NULL."""
    e = spec.entity
    x = finite(c).cast("double").alias("__v")
    fitted = train.select(e, x, F.lit(1).alias("__n")).filter(F.col("__v").isNotNull())
    asked = df.select(e, x, F.lit(0).alias("__n")).filter(F.col("__v").isNotNull())
    values = fitted.unionByName(asked).groupBy(e, "__v").agg(F.sum("__n").alias("__n"))
    totals = fitted.groupBy(e).agg(F.count(F.lit(1)).alias("__total"))
    placed = join_table(weight_below(values, [e], "__v", "__n", spec, "__less"), totals, [e], spec)
    pct = placed.select(
        e,
        F.col("__v").alias(c),
        (
            (F.col("__less") + F.col("__n") / F.lit(2.0))
            / F.greatest(F.col("__total") - 1, F.lit(1))
        ).alias(f"{c}_pctl"),
    )
    out = attach(df, pct, [e, c])
    return out.withColumn("is_high_residual", flag(F.col(f"{c}_pctl") >= 0.8))


def quantile_bins(
    train: DataFrame, df: DataFrame, c: str, k: int, spec: PanelSpec, out: str | None = None
) -> DataFrame:
    """Index of the training quantile bin, right-closed with the lowest edge included; NULL out
    of range. Repeated edges are merged."""
    e = spec.entity
    want = {f"__q{i}": (c, i / k) for i in range(k + 1)}
    edges = quantiles(train, [e], want, spec).select(
        e, F.array_distinct(F.array(*want)).alias("__edges")
    )
    x, arr = F.col(c), F.col("__edges")
    inner = F.slice(arr, F.lit(2), F.greatest(F.size(arr) - 2, F.lit(0)))
    index = F.size(F.filter(inner, lambda q: q < x)).cast("double")
    inside = (F.size(arr) > 1) & x.between(F.element_at(arr, 1), F.element_at(arr, -1))
    return (
        join_table(df, edges, [e], spec)
        .withColumn(out or f"{c}_bin{k}", F.when(inside, index))
        .drop("__edges")
    )


def standardize(train: DataFrame, df: DataFrame, c: str, spec: PanelSpec) -> DataFrame:
    """z by entity with the population std, or 1 where that vanishes."""
    e = spec.entity
    t = train.groupBy(e).agg(F.avg(c).alias("__mean"), F.stddev_pop(c).alias("__std"))
    std = F.when(F.col("__std") > 1e-9, F.col("__std")).otherwise(1.0)
    return (
        join_table(df, t, [e], spec)
        .withColumn(f"{c}_z", (F.col(c) - F.col("__mean")) / std)
        .drop("__mean", "__std")
    )


def stress_thresholds(
    train: DataFrame, df: DataFrame, spec: PanelSpec, hours: Sequence[int] = LATE_PEAK
) -> DataFrame:
    """Load above its late-peak q90 and wind below its late-peak q10, their product and ramp.

    Uses ``load_forecast_lag_1`` if present; without it the ramp is NULL.
    """
    e = spec.entity
    late = train.filter(F.col("hour").isin(*hours))
    t = quantiles(
        late, [e], {"__l90": ("load_forecast", 0.9), "__w10": ("wind_forecast", 0.1)}, spec
    )
    out = join_table(df, t, [e], spec)
    at = flag(F.col("hour").isin(*hours))
    load, wind = F.col("load_forecast"), F.col("wind_forecast")
    excess, deficit = positive(load - F.col("__l90")), positive(F.col("__w10") - wind)
    ramp = (
        load - F.col("load_forecast_lag_1")
        if has(df, "load_forecast_lag_1")
        else F.lit(None).cast("double")
    )
    return out.withColumns(
        {
            "excess_load_90": excess,
            "wind_deficit_10": deficit,
            "stress_excess": excess * deficit,
            "stress_excess_1819": excess * deficit * at,
            "load_diff_1": ramp,
            "neg_load_ramp_1": positive(-ramp),
            "stress_ramp_1819": at * deficit * positive(-ramp),
        }
    ).drop("__l90", "__w10")


# --- regimes -------------------------------------------------------------------------------

# Threshold name -> (column, quantile, hours it is taken over).
REGIME_THRESHOLDS = {
    "lowprice_residual": ("residual_load", 0.25, MIDDAY),
    "lowprice_solar": ("solar_share", 0.75, MIDDAY),
    "transition_ramp": ("abs_residual_ramp_1", 0.85, None),
    "transition_std": ("residual_load_roll_std_6", 0.85, None),
    "peak_residual": ("residual_load", 0.80, EVENING_PEAK),
    "peak_windshare": ("wind_share", 0.20, EVENING_PEAK),
    "peak_stress": ("stress_ratio", 0.80, EVENING_PEAK),
}


def _regime_quantiles() -> dict[str, tuple[Column, float]]:
    return {
        name: (
            F.col(c) if hours is None else F.when(F.col("hour").isin(*hours), F.col(c)),
            q,
        )
        for name, (c, q, hours) in REGIME_THRESHOLDS.items()
    }


def fit_regimes(train: DataFrame, spec: PanelSpec, hit_share: float = 0.10) -> DataFrame:
    """One row per entity: seven thresholds, their global defaults (``g_`` columns), and
    whether the stress filter is on (more than a tenth of its peak rows pass the base rule)."""
    e = spec.entity
    want = _regime_quantiles()
    overall = row_scalars(quantiles(train, [], {f"g_{k}": v for k, v in want.items()}, spec))
    # Small tables; fixing them here keeps the training rows from being read again per use.
    t = materialize(quantiles(train, [e], want, spec).withColumns(overall))
    peak = F.col("hour").isin(*EVENING_PEAK)
    base = (
        peak
        & (F.col("residual_load") >= F.coalesce("peak_residual", "g_peak_residual"))
        & (F.col("wind_share") <= F.coalesce("peak_windshare", "g_peak_windshare"))
    )
    share = (
        join_table(train, t, [e], spec)
        .groupBy(e)
        .agg(F.try_divide(F.sum(flag(base)), F.sum(flag(peak))).alias("__share"))
    )
    return materialize(
        join_table(t, share, [e], spec)
        .withColumn("stress_filter", truth(F.col("__share") > hit_share))
        .drop("__share")
    )


def apply_regimes(df: DataFrame, thresholds: DataFrame, spec: PanelSpec) -> DataFrame:
    """Low-price midday, peak scarcity and transition flags and the first that holds.

    Entities without thresholds use the global defaults. Cross-section ranks
    (``residual_load_xmk_rank_pct``, ``solar_share_xmk_rank_pct``) count as 0.5 if absent.
    """
    names = list(REGIME_THRESHOLDS)
    defaults = row_scalars(thresholds.agg(*[F.max(f"g_{n}").alias(n) for n in names]))
    local = thresholds.select(
        spec.entity, "stress_filter", *[F.col(n).alias(f"__{n}") for n in names]
    )
    out = join_table(df, local, [spec.entity], spec)
    q = {n: F.coalesce(f"__{n}", defaults[n]) for n in names}

    def rank(c: str) -> Column:
        return F.col(c) if has(df, c) else F.lit(0.5)

    midday, peak = F.col("hour").isin(*MIDDAY), F.col("hour").isin(*EVENING_PEAK)
    residual, solar = F.col("residual_load"), F.col("solar_share")
    low = truth((residual <= q["lowprice_residual"]) & (solar >= q["lowprice_solar"])) | truth(
        (rank("residual_load_xmk_rank_pct") <= 0.25) & (rank("solar_share_xmk_rank_pct") >= 0.75)
    )
    scarce = truth(
        peak
        & (residual >= q["peak_residual"])
        & (F.col("wind_share") <= q["peak_windshare"])
        & (~truth(F.col("stress_filter")) | truth(F.col("stress_ratio") >= q["peak_stress"]))
    )
    moving = truth(F.col("abs_residual_ramp_1") >= q["transition_ramp"]) | truth(
        F.col("residual_load_roll_std_6") >= q["transition_std"]
    )
    out = out.withColumns(
        {"lowprice_midday": truth(midday) & low, "peak_scarcity": scarce, "transition": moving}
    )
    a, b, c = (F.col(n) for n in ("lowprice_midday", "peak_scarcity", "transition"))
    label = (
        F.when(a, "lowprice_midday")
        .when(b, "peak_scarcity")
        .when(c, "transition")
        .otherwise("normal")
    )
    return out.withColumns({"normal": ~(a | b | c), "primary_regime": label}).drop(
        "stress_filter", *[f"__{n}" for n in names]
    )


def storm(
    train: DataFrame,
    df: DataFrame,
    spec: PanelSpec,
    cape: str = "convective_available_potential_energy",
    cin: str = "convective_inhibition",
    lifted: str = "lifted_index",
) -> DataFrame:
    """log(1 + CAPE) where convection is likely, and a flag above its training q90.

    Likely means CIN at or under its entity's training q20, else lifted index <= -2. Rows whose
    table lacks the column are at no risk; without a threshold the flag is NULL.
    """
    e = spec.entity
    if not has(df, cape):
        none = F.lit(None).cast("double")
        return df.withColumns({"storm_risk": none, "storm_flag": none.cast("int")})
    energy = F.log1p(positive(cape))

    def risk(frame: DataFrame) -> DataFrame:
        if has(train, cin) and not has(frame, cin):
            on = F.lit(0)
        elif has(train, cin):
            limit = quantiles(train, [e], {"__cin": (cin, 0.2)}, spec)
            overall = row_scalars(quantiles(train, [], {"g": (cin, 0.2)}, spec))["g"]
            frame = join_table(frame, limit, [e], spec)
            on = flag(F.col(cin) <= F.coalesce("__cin", overall))
        elif has(train, lifted) and has(frame, lifted):
            on = flag(F.col(lifted) <= -2.0)
        else:
            on = F.lit(0)
        return frame.withColumn("storm_risk", energy * on).drop("__cin")

    high = row_scalars(quantiles(risk(train), [], {"q": ("storm_risk", 0.9)}, spec))["q"]
    above = F.when(high.isNotNull(), flag(F.col("storm_risk") > high))
    return risk(df).withColumn("storm_flag", above)


# --- imputation and coverage ---------------------------------------------------------------


def impute(
    train: DataFrame, df: DataFrame, num: Sequence[str], cat: Sequence[str], spec: PanelSpec
) -> DataFrame:
    """Entity median, then the median of the training column so filled; text gets "missing"."""
    e = spec.entity
    local = quantiles(train, [e], {f"__m_{c}": (c, 0.5) for c in num}, spec)
    filled = join_table(train, local, [e], spec).withColumns(
        {c: F.coalesce(c, f"__m_{c}") for c in num}
    )
    overall = row_scalars(quantiles(filled, [], {c: (c, 0.5) for c in num}, spec))
    out = join_table(df, local, [e], spec).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"__m_{c}"), overall[c]) for c in num}
        | {c: F.coalesce(F.col(c), F.lit("missing")) for c in cat}
    )
    return out.drop(*[f"__m_{c}" for c in num])


def coverage(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Per entity: rows, span, target mean / std, null share of ``cols``, and the number of
    rows beyond the first of their (entity, ts)."""
    per_ts = df.groupBy(spec.entity, spec.ts).agg(F.count(F.lit(1)).alias("__rows"))
    base = df.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(spec.ts).alias("min_ts"),
        F.max(spec.ts).alias("max_ts"),
        F.avg(spec.target).alias("target_mean"),
        F.stddev_samp(spec.target).alias("target_std"),
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"null_share_{c}") for c in cols],
    )
    extra = per_ts.groupBy(spec.entity).agg((F.sum("__rows") - F.count(F.lit(1))).alias("duplicates"))
    return join_table(base, extra, [spec.entity], spec)
