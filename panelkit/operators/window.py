"""Ordered-window features per entity and cross-sections per timestamp.

Row semantics: lags count rows in (ts, id) order, and rolling frames cover the rows strictly
before the current one. All per-entity frames go through ``row_frames`` / ``running`` so that a
single long entity is spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import clip, flag, ratio
from panelkit.plans.layout import Frames, PanelSpec, attach, row_frames, running
from panelkit.plans.ranks import rank_pct

AGGS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
# Above this length a frame is put together from blocks instead of re-aggregation.
LONG_FRAME = 168


def lags(df: DataFrame, spec: PanelSpec, cols: Sequence[str], ks: Sequence[int]) -> DataFrame:
    f = row_frames(df, spec, max(ks))
    return f.done(
        f.df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(f.window) for c in cols for k in ks})
    )


def diffs(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], ks: Sequence[int], absolute: bool = False
) -> DataFrame:
    """value - lag, and its size as ``_absdiff_k`` on request."""
    f = row_frames(df, spec, max(ks))
    out = {f"{c}_diff_{k}": F.col(c) - F.lag(c, k).over(f.window) for c in cols for k in ks}
    if absolute:
        out |= {
            f"{c}_absdiff_{k}": F.abs(F.col(c) - F.lag(c, k).over(f.window))
            for c in cols
            for k in ks
        }
    return f.done(f.df.withColumns(out))


def _guarded(f: Frames, c: str, n: int, fn: str, min_periods: int) -> Column:
    w = f.prev(n)
    return F.when(F.count(c).over(w) >= min_periods, AGGS[fn](c).over(w))


def rolling(
    df: DataFrame,
    spec: PanelSpec,
    cols: Sequence[str],
    windows: Sequence[int],
    fns: Sequence[str] = ("mean", "std"),
    min_periods: Mapping[str, int] | int | None = None,
) -> DataFrame:
    """Aggregates of the previous n rows, NULL below ``min_periods`` present values."""
    need = {"mean": 1, "std": 2, "min": 1, "max": 1}
    if isinstance(min_periods, int):
        need = dict.fromkeys(need, min_periods)
    elif min_periods:
        need |= dict(min_periods)
    f = row_frames(df, spec, max(windows))
    out = f.df.withColumns(
        {
            f"{c}_roll_{fn}_{n}": _guarded(f, c, n, fn, need[fn])
            for c in cols
            for n in windows
            if n <= LONG_FRAME
            for fn in fns
        }
    )
    long = {n: {fn: need[fn] for fn in fns} for n in windows if n > LONG_FRAME}
    return f.done(long_rolling(out, f, dict.fromkeys(cols, long)) if long else out)


Frame = Mapping[int, Mapping[str, int]]


def long_rolling(df: DataFrame, f: Frames, wanted: Mapping[str, Frame]) -> DataFrame:
    """Mean, std, min and max of long frames, in steps that grow with log2(n) for frames of n rows.

    ``wanted`` maps a column to {n: {function: min_periods}}. What the 1, 2, 4, ... rows up to each row hold comes
    from what half as many hold, for all columns in one step a level. A mean or std is put together from the blocks that n
    in binary names; a min or max from two blocks that overlap. Nothing is subtracted, so what
    lies outside a frame leaves no trace in it."""
    series, joined, counts = {}, {}, {}
    for i, (c, frames) in enumerate(wanted.items()):
        v = F.col(c)
        fns = {n: set(some) for n, some in frames.items()}
        if moments := [n for n, some in fns.items() if some & {"mean", "std"}]:
            present = F.when(v.isNull(), 0).otherwise(1).cast("long")
            series[f"__m{i}"] = Blocks(
                _moments(present, F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)), _combined, moments
            )
        for fn, pick in (("min", F.least), ("max", F.greatest)):
            if some := [n for n, have in fns.items() if fn in have]:
                series[f"__{fn}{i}"] = Blocks(v, pick, some, overlap=True)
                counts |= {(c, n): f"__n{i}_{n}" for n in some}
        joined[c] = i
    df, at, made = blocks(df, f, series)
    # Whole numbers are the one thing that may be subtracted.
    before = f.window.rowsBetween(W.unboundedPreceding, -1)
    running = {f"__n{joined[c]}": F.count(c).over(before) for c in {c for c, _ in counts}}
    df = df.withColumns(running)
    df = df.withColumns(
        {
            name: F.col(f"__n{joined[c]}") - F.coalesce(F.lag(f"__n{joined[c]}", n).over(f.window), F.lit(0))
            for (c, n), name in counts.items()
        }
    )
    out = {}
    for c, frames in wanted.items():
        i = joined[c]
        for n, fns in frames.items():
            for fn, need in fns.items():
                if fn in ("min", "max"):
                    value, count, least = F.col(at[f"__{fn}{i}", n]), F.col(counts[c, n]), 1
                else:
                    total = F.col(at[f"__m{i}", n])
                    count, least = F.coalesce(total["n"], F.lit(0)), 1 if fn == "mean" else 2
                    value = total["mean"] if fn == "mean" else F.sqrt(total["dev"] / (count - 1))
                out[f"{c}_roll_{fn}_{n}"] = F.when((count >= need) & (count >= least), value)
    return df.withColumns(out).drop(*made, *running, *counts.values())


@dataclass(frozen=True)
class Blocks:
    """What one row holds, how two neighbouring blocks (the later one first) join, and the frame lengths
    wanted. ``overlap``: a row may be counted twice."""

    row: Column
    join: Callable[[Column, Column], Column]
    frames: Sequence[int]
    overlap: bool = False


def blocks(
    df: DataFrame, f: Frames, series: Mapping[str, Blocks], first: int = 1
) -> tuple[DataFrame, dict[tuple[str, int], str], list[str]]:
    """Columns with the joined blocks of the n rows that end ``first`` rows before each row, for every series
    and frame length; where they are; and all columns made. A frame before the first row is NULL."""
    window = f.window
    df = df.withColumns({f"{name}_0": b.row for name, b in series.items()})
    made = [f"{name}_0" for name in series]
    at: dict[tuple[str, int], str] = {}
    for k in range(max((n for b in series.values() for n in b.frames), default=0).bit_length()):
        out = {}
        for name, b in series.items():
            half = f"{name}_{k}"
            for n in b.frames:
                top = n.bit_length() - 1
                if b.overlap and k == top:
                    late, early = F.lag(half, first).over(window) if first else F.col(half), F.lag(half, n - (1 << k) + first)
                    out[f"{name}_f{n}"] = b.join(late, early.over(window)) if n != 1 << k else late
                    at[name, n] = f"{name}_f{n}"
                elif not b.overlap and n >> k & 1:
                    back = (n & ((1 << k) - 1)) + first
                    piece = F.lag(half, back).over(window) if back else F.col(half)
                    out[f"{name}_f{n}_{k}"] = b.join(F.col(at[name, n]), piece) if (name, n) in at else piece
                    at[name, n] = f"{name}_f{n}_{k}"
            if any(n >> (k + 1) for n in b.frames):
                out[f"{name}_{k + 1}"] = b.join(F.col(half), F.lag(half, 1 << k).over(window))
        df = df.withColumns(out)
        made += out
    return df, at, made


def _moments(n: Column, mean: Column, dev: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), dev.alias("dev"))


def _combined(a: Column, b: Column) -> Column:
    """Moments of two sets of rows together; NULL is no rows."""
    n = a["n"] + b["n"]
    gap, share = b["mean"] - a["mean"], b["n"] / n
    both = _moments(n, a["mean"] + gap * share, a["dev"] + b["dev"] + gap * gap * share * a["n"])
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


def _pair_moments(n, x, y, xx, yy, xy) -> Column:
    parts = {"n": n, "x": x, "y": y, "xx": xx, "yy": yy, "xy": xy}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def _pair_combined(a: Column, b: Column) -> Column:
    """Means and products of deviations of two sets of pairs together; NULL is no pairs."""
    n = a["n"] + b["n"]
    gx, gy, share = b["x"] - a["x"], b["y"] - a["y"], b["n"] / n
    weight = share * a["n"]
    both = _pair_moments(
        n, a["x"] + gx * share, a["y"] + gy * share,
        a["xx"] + b["xx"] + gx * gx * weight, a["yy"] + b["yy"] + gy * gy * weight, a["xy"] + b["xy"] + gx * gy * weight,
    )
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


def anomaly(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Distance to the previous 24- and 168-row mean, and z on 168 rows."""
    f = row_frames(df, spec, 168)
    out = {}
    for c in cols:
        week = _guarded(f, c, 168, "mean", 24)
        out[f"{c}_anom_24"] = F.col(c) - _guarded(f, c, 24, "mean", 6)
        out[f"{c}_anom_168"] = F.col(c) - week
        out[f"{c}_z_168"] = ratio(F.col(c) - week, _guarded(f, c, 168, "std", 24))
    return f.done(f.df.withColumns(out))


def volatility(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], week: int = 168, month: int = 672
) -> DataFrame:
    """Size of one-row changes against its own 168- and 672-row history."""
    f = row_frames(df, spec, month + 1)
    out = f.df.withColumns(
        {f"{c}_absdiff_1": F.abs(F.col(c) - F.lag(c, 1).over(f.window)) for c in cols}
    )
    long = {f"{c}_absdiff_1": {month: {"mean": 48, "std": 48}} for c in cols}
    out = out.withColumns({f"{c}_vol_7d": _guarded(f, f"{c}_absdiff_1", week, "mean", 24) for c in cols})
    out = long_rolling(out, f, long)
    made = {}
    for c in cols:
        v7 = F.col(f"{c}_vol_7d")
        v28, s28 = (F.col(f"{c}_absdiff_1_roll_{fn}_{month}") for fn in ("mean", "std"))
        made |= {
            f"{c}_vol_28d": v28,
            f"{c}_vol_ratio_7d_28d": ratio(v7, v28),
            f"{c}_vol_z_7d_28d": ratio(v7 - v28, s28),
            f"{c}_vol_regime_high": flag(ratio(v7, v28) > 1.15),
        }
    out = out.withColumns(made).drop(*[f"{a}_roll_{fn}_{month}" for a in long for fn in ("mean", "std")])
    return f.done(out)


def slow_state(
    df: DataFrame, spec: PanelSpec, c: str, windows: Sequence[int] = (24, 168, 720)
) -> DataFrame:
    """Rolling mean / std with min_periods max(6, n // 4)."""
    f = row_frames(df, spec, max(windows))
    out = f.df
    need = {n: max(6, n // 4) for n in windows}
    out = out.withColumns(
        {
            f"{c}_roll_{fn}_{n}": _guarded(f, c, n, fn, need[n])
            for n in windows
            if n <= LONG_FRAME
            for fn in ("mean", "std")
        }
    )
    long = {n: {"mean": need[n], "std": need[n]} for n in windows if n > LONG_FRAME}
    return f.done(long_rolling(out, f, {c: long}) if long else out)


def transition(df: DataFrame, spec: PanelSpec, c: str = "residual_load") -> DataFrame:
    """Lag 1, change over 1 and 6 rows, their sizes, and std of the previous 6 rows."""
    f = row_frames(df, spec, 6)
    one, six = F.lag(c, 1).over(f.window), F.lag(c, 6).over(f.window)
    short = c.removesuffix("_load")
    return f.done(
        f.df.withColumns(
            {
                f"{c}_lag_1": one,
                f"{c}_diff_1": F.col(c) - one,
                f"abs_{short}_ramp_1": F.abs(F.col(c) - one),
                f"{c}_diff_6": F.col(c) - six,
                f"abs_{short}_ramp_6": F.abs(F.col(c) - six),
                f"{c}_roll_std_6": _guarded(f, c, 6, "std", 6),
            }
        )
    )


# Lag steps and rolling windows of the exogenous block.
EXOG_LAGS = (1, 2, 6, 24, 48, 168)
EXOG_WINDOWS = (6, 24, 72)


def exog_block(
    df: DataFrame,
    spec: PanelSpec,
    cols: Sequence[str],
    enabled: Sequence[str] | None = None,
    lag_steps: Sequence[int] = EXOG_LAGS,
    windows: Sequence[int] = EXOG_WINDOWS,
    min_periods: int = 4,
) -> DataFrame:
    """Lags, ramps and rolling mean / std; all zero for entities that are not enabled."""
    f = row_frames(df, spec, max([*lag_steps, *windows]))
    on = F.lit(True) if enabled is None else F.coalesce(F.col(spec.entity).isin(*enabled), F.lit(False))
    raw = {}
    for c in cols:
        for k in lag_steps:
            raw[f"{c}_lag_{k}"] = F.lag(c, k).over(f.window)
            raw[f"{c}_ramp_{k}"] = F.col(c) - F.lag(c, k).over(f.window)
        for n in windows:
            for fn in ("mean", "std"):
                raw[f"{c}_roll_{fn}_{n}"] = _guarded(f, c, n, fn, min_periods)
    out = {name: e if enabled is None else F.when(on, e).otherwise(0.0) for name, e in raw.items()}
    return f.done(f.df.withColumns({"exog_lag_enabled": flag(on)} | out))


def expanding_prev(
    df: DataFrame, spec: PanelSpec, keys: Sequence[str], c: str, prefix: str
) -> DataFrame:
    """Past-only count, mean, mean square, population std and rms of ``c`` per group.

    The count covers all earlier rows of the group, also those with a missing value.
    """
    y = F.col(c)
    out = running(
        df, spec, keys, {"__n": F.lit(1), "__s": y.cast("double"), "__q": (y * y).cast("double")}
    )
    n = F.coalesce(F.col("__n"), F.lit(0)).cast("double")
    mean, sq = F.try_divide(F.col("__s"), n), F.try_divide(F.col("__q"), n)
    zero = F.lit(0.0)
    return out.withColumns(
        {
            f"{prefix}_dyn_count": n,
            f"{prefix}_dyn_mean": mean,
            f"{prefix}_dyn_sq_mean": sq,
            f"{prefix}_dyn_std": F.when(
                mean.isNotNull(), F.sqrt(F.greatest(sq - mean * mean, zero))
            ),
            f"{prefix}_dyn_rms": F.when(sq.isNotNull(), F.sqrt(F.greatest(sq, zero))),
        }
    ).drop("__n", "__s", "__q")


def _ts_stats(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], name: str = "{c}_xmk_{s}"
) -> DataFrame:
    """Mean and sample std over the entities of each timestamp.

    One window where a timestamp is proven small, else a pre-aggregated join.
    """
    made = {
        name.format(c=c, s=s): fn(c)
        for c in cols
        for s, fn in (("mean", F.avg), ("std", F.stddev_samp))
    }
    if spec.bounded([spec.ts]):
        at = W.partitionBy(spec.ts)
        return df.withColumns({k: e.over(at) for k, e in made.items()})
    stats = df.groupBy(spec.ts).agg(*[e.alias(k) for k, e in made.items()])
    return attach(df, stats, [spec.ts])


def cross_section(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Per timestamp: mean and std over entities, and each row's distance and z."""
    out = _ts_stats(df, spec, cols)
    return out.withColumns(
        {f"{c}_xmk_diff": F.col(c) - F.col(f"{c}_xmk_mean") for c in cols}
        | {
            f"{c}_xmk_z": ratio(F.col(c) - F.col(f"{c}_xmk_mean"), f"{c}_xmk_std") for c in cols
        }
    )


def pct_rank_avg(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], by: Sequence[str] | None = None
) -> DataFrame:
    """Average-tie percent rank of each column among the rows of its timestamp."""
    return rank_pct(df, by or [spec.ts], cols, spec, "_xmk_rank_pct")


def robust_cross(
    df: DataFrame,
    spec: PanelSpec,
    cols: Sequence[str],
    min_std: float = 1e-3,
    z_clip: float = 5.0,
) -> DataFrame:
    """Cross-section with z 0 and rank 0.5 where the spread vanishes, z clipped."""
    out = pct_rank_avg(_ts_stats(df, spec, cols), spec, cols)
    made = {}
    for c in cols:
        diff, std = F.col(c) - F.col(f"{c}_xmk_mean"), F.col(f"{c}_xmk_std")
        wide = F.coalesce(F.abs(std) > min_std, F.lit(False))
        made[f"{c}_xmk_diff"] = diff
        made[f"{c}_xmk_z"] = F.when(wide, clip(ratio(diff, std), -z_clip, z_clip)).otherwise(0.0)
        made[f"{c}_xmk_rank_pct"] = F.when(wide, F.col(f"{c}_xmk_rank_pct")).otherwise(0.5)
    return out.withColumns(made)


def extreme_flags(
    df: DataFrame, spec: PanelSpec, cols: Sequence[str], top: float = 0.9, bottom: float = 0.1
) -> DataFrame:
    """Flags for the top and bottom tenth of each timestamp."""
    out = pct_rank_avg(df, spec, cols)
    made = {}
    for c in cols:
        rank = F.col(f"{c}_xmk_rank_pct")
        made[f"is_top10_{c}"] = flag(rank >= top)
        made[f"is_bottom10_{c}"] = flag(rank <= bottom)
    return out.withColumns(made).drop(*[f"{c}_xmk_rank_pct" for c in cols])


def residual_rolling(df: DataFrame, spec: PanelSpec, c: str = "residual_load") -> DataFrame:
    """Lags 1 and 24, changes, 720-row mean (at least 24 values) and the gap to it."""
    f = row_frames(df, spec, 720)
    one, day = F.lag(c, 1).over(f.window), F.lag(c, 24).over(f.window)
    out = f.df.withColumns(
        {
            f"{c}_lag1": one,
            f"{c}_lag24": day,
            f"{c}_delta_1": F.col(c) - one,
            f"{c}_delta_24": F.col(c) - day,
        }
    )
    out = long_rolling(out, f, {c: {720: {"mean": 24}}}).withColumnRenamed(
        f"{c}_roll_mean_720", f"{c}_rollmean_30d"
    )
    return f.done(out.withColumn(f"{c}_vs_30d", F.col(c) - F.col(f"{c}_rollmean_30d")))


def rolling_pair_corr(
    df: DataFrame,
    spec: PanelSpec,
    pairs: Sequence[tuple[str, str]],
    n: int,
    min_periods: int,
    shift: bool = True,
    value: str | None = None,
) -> DataFrame:
    """Correlation of two entities over the last n timestamps, as (a, b, ts, corr) rows.

    Positions are the distinct timestamps of the panel. With ``shift`` a row sees only the
    timestamps before it. Pairs are rows, so they run in parallel and a long history is split.
    """
    value = value or spec.target
    names = sorted({e for p in pairs for e in p})
    wide = (
        df.groupBy(spec.ts)
        .pivot(spec.entity, names)
        .agg(F.avg(value))
        .select(spec.ts, *[F.col(f"`{e}`").alias(f"__v{i}") for i, e in enumerate(names)])
    )
    at = {e: F.col(f"__v{i}") for i, e in enumerate(names)}
    long = wide.select(
        spec.ts,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("a"), F.lit(b).alias("b"), at[a].alias("x"), at[b].alias("y")
                    )
                    for a, b in pairs
                ]
            )
        ).alias("__p"),
    ).select(spec.ts, "__p.*")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    long = long.withColumns({"x": F.when(both, F.col("x")), "y": F.when(both, F.col("y"))})
    plain = PanelSpec(
        entity="a",
        ts=spec.ts,
        id=spec.ts,
        chunk_rows=spec.chunk_rows,
        bucket_seconds=spec.bucket_seconds,
        bounds={("a", "b"): _distinct_ts_bound(spec)} if _distinct_ts_bound(spec) else {},
    )
    f = row_frames(long, plain, n + 1, ["a", "b"])
    last = 1 if shift else 0
    x, y = F.col("x"), F.col("y")
    least = max(min_periods, 2)
    if n > LONG_FRAME:
        present = F.when(x.isNull(), 0).otherwise(1).cast("long")
        zero = F.lit(0.0)
        row = _pair_moments(present, F.coalesce(x.cast("double"), zero), F.coalesce(y.cast("double"), zero), zero, zero, zero)
        df, at, made = blocks(f.df, f, {"__p": Blocks(row, _pair_combined, [n])}, last)
        total = F.col(at["__p", n])
        enough = F.coalesce(total["n"], F.lit(0)) >= least
        corr = F.try_divide(total["xy"], F.sqrt(total["xx"]) * F.sqrt(total["yy"]))
        out = df.withColumn("corr", F.when(enough, clip(corr, -1.0, 1.0))).drop(*made)
    else:
        frame = f.window.rowsBetween(-(n - 1 + last), -last)
        cov = F.covar_samp(x, y).over(frame)
        spread = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
        enough = F.count(x).over(frame) >= least
        out = f.df.withColumn("corr", F.when(enough, clip(F.try_divide(cov, spread), -1.0, 1.0)))
    return f.done(out).select("a", "b", spec.ts, "corr")


def _distinct_ts_bound(spec: PanelSpec):
    """An entity-by-timestamp panel has at most as many timestamps as it has rows."""
    return spec.bounds.get(())
