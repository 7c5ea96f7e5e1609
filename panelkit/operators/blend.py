"""Calibration, caps and blends over prediction tables.

Fits return small cell tables; everything applied per row is built-in column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import clip, flag, num, positive, truth
from panelkit.operators.joins import align_predictions, lookup_backoff, ordered_bounds
from panelkit.operators.profile import join_table, scopes, summarize
from panelkit.plans.layout import PanelSpec, attach, row_scalars, scalars
from panelkit.plans.ranks import first_rows, quantiles
from panelkit.sources.io import materialize

# --- averages ------------------------------------------------------------------------------


def normalized(weights: Sequence[float]) -> list[float]:
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return [w / total for w in weights]


def weighted_average(
    preds: Mapping[str, DataFrame], weights: Sequence[float] | None = None, out: str = "target"
) -> DataFrame:
    """Normalised weighted mean by id over ids present in every table; equal by default."""
    if weights is not None and len(weights) != len(preds):
        raise ValueError("one weight per table")
    w = normalized(weights or [1.0] * len(preds))
    wide = align_predictions(preds)
    total = sum((F.col(name) * F.lit(x) for name, x in zip(preds, w)), F.lit(0.0))
    return wide.select("id", total.alias(out))


def inverse_error_weights(
    metrics: DataFrame, name: str = "name", error: str = "rmse", power: float = 2.0
) -> DataFrame:
    """Weights 1 / max(error, 1e-6)^power, summing to 1. ``metrics`` has one row per model."""
    raw = metrics.select(
        name, (1.0 / F.pow(clip(error, low=1e-6), F.lit(float(power)))).alias("__w")
    )
    total = scalars(raw, F.sum("__w").alias("s"))["s"]
    return raw.select(name, (F.col("__w") / total).alias("weight"))


def fold_weights(metrics: DataFrame, error: str = "rmse") -> DataFrame:
    """Unnormalised fold weight 1 / (error + 1e-6)."""
    return metrics.withColumn("weight", 1.0 / (F.col(error) + 1e-6))


def fold_weighted_blend(
    preds: DataFrame, key: str = "id", pred: str = "pred", weight: str = "weight"
) -> DataFrame:
    """sum(pred * w) / sum(w) by id over folds, configurations and seeds."""
    w = F.when(F.col(pred).isNotNull(), F.col(weight))
    return preds.groupBy(key).agg(
        F.try_divide(F.sum(F.col(pred) * w), F.sum(w)).alias("target")
    )


def mix_experts(base: Column | str, experts: Sequence[tuple[float, Column | str]]) -> Column:
    """base + sum of fixed weights times expert predictions."""
    return sum((F.lit(float(w)) * num(c) for w, c in experts), num(base))


def gated_pair(prob: Column | str, expert: Column | str, normal: Column | str) -> Column:
    """Expert and normal prediction mixed by a probability."""
    p = num(prob)
    return p * num(expert) + (1.0 - p) * num(normal)


def dual_blend(a: Column | str, b: Column | str, w_a: Column | float, w_b: Column | float) -> Column:
    """Two models with weights clipped at 0 and normalised; the first alone if both vanish or
    the second has no prediction."""
    wa, wb = positive(w_a), positive(w_b)
    total = wa + wb
    share = F.when(total > 0, wb / total).otherwise(0.0)
    use = (share > 0) & num(b).isNotNull()
    return F.when(use, (1.0 - share) * num(a) + share * num(b)).otherwise(num(a))


# --- caps ----------------------------------------------------------------------------------


def guardrail_fit(
    train: DataFrame, spec: PanelSpec, lo: float, hi: float, c: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quantile bounds ``low`` / ``high`` by (entity, hour), by entity and overall."""
    c = c or spec.target
    want = {"low": (c, lo), "high": (c, hi)}
    e = spec.entity
    return tuple(quantiles(train, keys, want, spec) for keys in ([e, "hour"], [e], []))


def guardrail_apply(
    df: DataFrame, bounds: tuple[DataFrame, DataFrame, DataFrame], spec: PanelSpec, pred: str
) -> DataFrame:
    """Hard clip into the bounds, with ``was_clipped`` per row."""
    cell, entity, overall = bounds
    out = ordered_bounds(
        lookup_backoff(df, cell, entity, row_scalars(overall), ["low", "high"], spec)
    )
    clipped = clip(pred, "low", "high")
    return (
        out.withColumn("was_clipped", flag(F.abs(clipped - F.col(pred)) > 1e-12))
        .withColumn(pred, clipped)
        .drop("low", "high")
    )


def soft_cap_fit(
    train: DataFrame,
    spec: PanelSpec,
    lo: float,
    hi: float,
    min_rows: int,
    overrides: Mapping[str, Mapping[str, float]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cap tables (lower, upper); cells under ``min_rows`` are left out.

    ``overrides`` gives an entity its own lower_q / upper_q / min_rows; an invalid pair of
    quantiles falls back to the default. Each distinct pair is one conditional quantile.
    """
    e, y = spec.entity, F.col(spec.target)
    pairs: list[tuple[float, float]] = [(lo, hi)]
    index, need = F.lit(0), F.lit(min_rows)
    for name, over in (overrides or {}).items():
        pair = float(over.get("lower_q", lo)), float(over.get("upper_q", hi))
        if not 0.0 <= pair[0] < pair[1] <= 1.0:
            pair = (lo, hi)
        if pair not in pairs:
            pairs.append(pair)
        rows = int(over.get("min_rows", min_rows))
        mine = F.col(e) == name
        index = F.when(mine, pairs.index(pair)).otherwise(index)
        need = F.when(mine, rows if rows >= 1 else min_rows).otherwise(need)
    want = {}
    for i, (a, b) in enumerate(pairs):
        part = F.when(index == i, y)
        want |= {f"__l{i}": (part, a), f"__u{i}": (part, b)}

    def table(keys: list[str]) -> DataFrame:
        wide = summarize(train, keys, {"n": F.count(F.lit(1))}, want, spec)
        pick = [F.coalesce(*[F.col(f"__{s}{i}") for i in range(len(pairs))]) for s in "lu"]
        return wide.select(*keys, "n", pick[0].alias("lower"), pick[1].alias("upper"))

    cell = table([e, "hour"]).filter(F.col("n") >= need)
    overall = quantiles(train, [], {"lower": (y, lo), "upper": (y, hi)}, spec)
    return cell, table([e]), overall


def soft_cap_apply(
    df: DataFrame,
    caps: tuple[DataFrame, DataFrame, DataFrame],
    spec: PanelSpec,
    pred: str,
    softness: float,
) -> DataFrame:
    """Scale what lies beyond the cap by ``softness``; ``was_capped`` per row."""
    cell, entity, overall = caps
    out = lookup_backoff(df, cell, entity, row_scalars(overall), ["lower", "upper"], spec)
    p, low = F.col(pred), F.col("lower")
    high = F.greatest("upper", "lower")
    capped = (
        F.when(p > high, high + softness * (p - high))
        .when(p < low, low + softness * (p - low))
        .otherwise(p)
    )
    return (
        out.withColumn("was_capped", flag(F.abs(capped - p) > 1e-12))
        .withColumn(pred, capped)
        .drop("lower", "upper")
    )


# --- bias calibration ----------------------------------------------------------------------


def peak_bias_fit(
    oof: DataFrame, spec: PanelSpec, hours: Sequence[int], min_rows: int, pred: str = "pred"
) -> DataFrame:
    """Mean of target - pred per (entity, peak hour) with enough rows."""
    gap = F.col(spec.target) - F.col(pred)
    return (
        oof.filter(F.col("hour").isin(*hours) & F.col(spec.target).isNotNull())
        .groupBy(spec.entity, "hour")
        .agg(F.avg(gap).alias("bias"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") >= min_rows)
    )


def add_cell(
    df: DataFrame, table: DataFrame, keys: Sequence[str], c: str, spec: PanelSpec, pred: str
) -> DataFrame:
    """Add the cell's value of ``c`` to the prediction (0 for unknown cells)."""
    out = join_table(df, table.select(*keys, F.col(c).alias("__add")), keys, spec)
    return out.withColumn(pred, F.col(pred) + F.coalesce("__add", F.lit(0.0))).drop("__add")


def peak_bias_apply(df: DataFrame, table: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    return add_cell(df, table, [spec.entity, "hour"], "bias", spec, pred)


def cell_bias_calibration(
    oof: DataFrame,
    spec: PanelSpec,
    hours: Sequence[int],
    extra_rule: tuple[str, Sequence[int]] | None,
    alpha: float,
    min_rows: int,
    cap: float,
    pred: str = "pred",
) -> DataFrame:
    """Per (entity, hour): rows, bias and rmse of pred - target, and -alpha * bias within
    +-cap. ``extra_rule`` names one entity with additional hours of its own."""
    e = spec.entity
    general = F.col("hour").isin(*hours)
    own = F.lit(False)
    if extra_rule:
        own = (F.col(e) == extra_rule[0]) & F.col("hour").isin(*extra_rule[1])
    err = F.col(pred) - F.col(spec.target)
    cells = (
        oof.filter((general | own) & err.isNotNull())
        .groupBy(e, "hour")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(err).alias("bias"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
        )
        .filter(F.col("rows") >= min_rows)
    )
    raw = -alpha * F.col("bias")
    return cells.withColumns(
        {
            "raw_adjustment": raw,
            "adjustment": clip(raw, -cap, cap),
            "is_general_rule": flag(general),
            "is_extra_rule": flag(own),
        }
    )


def cell_bias_apply(df: DataFrame, table: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    return add_cell(df, table, [spec.entity, "hour"], "adjustment", spec, pred)


def residual_correction(
    oof: DataFrame, spec: PanelSpec, alpha: float, pred: str = "pred"
) -> DataFrame:
    """alpha times the mean residual per (entity, hour, dow)."""
    gap = F.col(spec.target) - F.col(pred)
    return (
        oof.filter(gap.isNotNull())
        .groupBy(spec.entity, "hour", "dow")
        .agg((F.lit(alpha) * F.avg(gap)).alias("correction"))
    )


def residual_correct(df: DataFrame, table: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    return add_cell(df, table, [spec.entity, "hour", "dow"], "correction", spec, pred)


# --- regime and tail blends ----------------------------------------------------------------

# Weight of the second model by regime; any other regime takes "normal".
GATE_WEIGHTS = {
    "none": {"transition": 1.0, "peak_scarcity": 1.0, "lowprice_midday": 1.0, "normal": 1.0},
    "rule": {"transition": 1.0, "peak_scarcity": 1.0, "lowprice_midday": 0.5, "normal": 0.3},
    "conservative": {"transition": 1.0, "peak_scarcity": 1.0, "lowprice_midday": 0.2, "normal": 0.1},
    "mid": {"transition": 1.0, "peak_scarcity": 1.0, "lowprice_midday": 0.35, "normal": 0.2},
}


def _by_regime(weights: Mapping[str, float], regime: str) -> Column:
    out = F.lit(float(weights["normal"]))
    for name, w in weights.items():
        if name != "normal":
            out = F.when(F.col(regime) == name, F.lit(float(w))).otherwise(out)
    return out


def regime_gate(mode: str, regime: str = "primary_regime") -> Column:
    if mode not in GATE_WEIGHTS:
        raise ValueError(f"unknown gate: {mode}")
    return _by_regime(GATE_WEIGHTS[mode], regime)


def regime_blend(
    df: DataFrame,
    p1: str,
    p2: str,
    weights: Mapping[str, float] | float,
    spec: PanelSpec,
    quiet_entity: str | None = None,
    out: str = "blend",
) -> DataFrame:
    """(1 - w) p1 + w p2 with w by regime (or one number), within 0..1. For ``quiet_entity``
    w is 0 in the normal regime outside 17-20 h."""
    w = num(weights) if isinstance(weights, (int, float)) else _by_regime(weights, "primary_regime")
    if quiet_entity is not None and not isinstance(weights, (int, float)):
        quiet = (
            (F.col(spec.entity) == quiet_entity)
            & (F.col("primary_regime") == "normal")
            & ~truth(F.col("hour").between(17, 20))
        )
        w = F.when(quiet, 0.0).otherwise(w)
    w = clip(w, 0.0, 1.0)
    return df.withColumn(out, (1.0 - w) * F.col(p1) + w * F.col(p2))


def adaptive_blend(
    df: DataFrame,
    train: DataFrame,
    spec: PanelSpec,
    anchor: str,
    core: str,
    ortho: str,
    *,
    anchor_weight: float,
    ortho_weight: float,
    temperature: float,
    peak_boost: float,
    max_ortho: float,
    delta_std: float,
    lo: float,
    hi: float,
    peak_hours: Sequence[int] = (17, 18, 19, 20),
    out: str = "blend",
) -> DataFrame:
    """Anchor / core mix plus an orthogonal model whose weight grows with the cell's volatility
    and at peak hours and decays with disagreement; the step away from the anchor is limited in
    cell stds, then the training quantile bounds apply."""
    e, y = spec.entity, spec.target
    known = train.filter(F.col(y).isNotNull() & F.col("hour").isNotNull())

    def table(keys: list[str]) -> DataFrame:
        std = F.coalesce(F.stddev_samp(y), F.lit(0.0))
        return summarize(known, keys, {"std": std}, {"low": (y, lo), "high": (y, hi)}, spec)

    # One small row, fixed so that the data is not read again for each use of it.
    overall = row_scalars(materialize(table([])))
    overall["std"] = F.when(overall["std"] > 0, overall["std"]).otherwise(1.0)
    names = ["low", "high", "std"]
    base = lookup_backoff(df, table([e, "hour"]), table([e]), overall, names, spec)
    base = ordered_bounds(base).withColumn(
        "std", F.when(F.col("std") <= 1e-9, overall["std"]).otherwise(F.col("std"))
    )
    a, std = F.col(anchor), F.col("std")
    mix = anchor_weight * a + (1.0 - anchor_weight) * F.col(core)
    gate = F.exp(-(F.abs(F.col(ortho) - mix) / (std + 1e-9)) / temperature)
    boost = F.when(F.col("hour").isin(*peak_hours), peak_boost).otherwise(1.0)
    w = clip(ortho_weight * clip(std / overall["std"], 0.5, 2.0) * boost * gate, 0.0, max_ortho)
    blended = (1.0 - w) * mix + w * F.col(ortho)
    if delta_std > 0:
        cap = F.greatest(delta_std * std, F.lit(1e-6))
        blended = a + clip(blended - a, -cap, cap)
    return base.withColumns(
        {"ortho_weight": w, out: clip(blended, "low", "high")}
    ).drop(*names)


def _tail(x: Column, mode: str, hi: Column, lo: Column | None) -> Column:
    if mode == "upper":
        return x >= hi
    if mode == "two_sided":
        return (x >= hi) | (x <= lo)
    if mode == "abs":
        return F.abs(x) >= hi
    raise ValueError(f"unknown mode: {mode}")


def tail_quantiles(c: str, mode: str, upper: float, lower: float) -> dict:
    x = F.abs(F.col(c)) if mode == "abs" else F.col(c)
    want = {"__hi": (x, upper)}
    if mode == "two_sided":
        want["__lo"] = (x, lower)
    return want


def peak_swap(
    df: DataFrame,
    base: str,
    best: str,
    mode: str,
    spec: PanelSpec,
    upper: float = 0.95,
    lower: float = 0.05,
    out: str = "swapped",
) -> DataFrame:
    """``base`` except where ``best`` lies in its own tail."""
    q = row_scalars(quantiles(df, [], tail_quantiles(best, mode, upper, lower), spec))
    mask = _tail(F.col(best), mode, q["__hi"], q.get("__lo"))
    return df.withColumn(out, F.when(mask, F.col(best)).otherwise(F.col(base)))


def replace_topk(
    pred: DataFrame,
    k: int,
    mode: str,
    method: str,
    spec: PanelSpec,
    value: float = 0.0,
    key: str = "id",
    c: str = "target",
) -> DataFrame:
    """Replace the k largest / smallest / largest absolute rows (ties by id) by the mean or
    median of the other rows or of all rows, or by a constant."""
    if k <= 0:
        raise ValueError("k must be positive")
    x = F.col(c)
    size = {"largest": -x, "smallest": x, "abs": -F.abs(x)}[mode]
    # Missing values are the smallest, and so the last by size downwards.
    order = [x.isNotNull() if mode == "smallest" else x.isNull(), size, F.col(key)]
    top = first_rows(pred.select(key, c), order, k).select(key, F.lit(True).alias("__top"))
    marked = attach(pred, top, [key], rows=k).withColumn("__top", truth(F.col("__top")))
    part = F.when(~F.col("__top"), x) if method.endswith("non_topk") else x
    if method == "value":
        new = F.lit(float(value))
    elif method.startswith("mean"):
        new = scalars(marked, F.avg(part).alias("v"))["v"]
    elif method.startswith("median"):
        new = row_scalars(quantiles(marked, [], {"v": (part, 0.5)}, spec))["v"]
    else:
        raise ValueError(f"unknown method: {method}")
    return marked.withColumns(
        {c: F.when(F.col("__top"), new).otherwise(x), "replaced": F.col("__top").cast("int")}
    ).drop("__top")


def missing_bump(
    df: DataFrame, missing: str, mult: float, spec: PanelSpec, pred: str = "target"
) -> DataFrame:
    """Add ``mult`` cell stds of the predictions to rows with missing weather; the std backs off
    from (entity, hour, dow) to (entity, hour), entity and overall."""
    out = df
    for name, keys in scopes(spec).items():
        table = df.groupBy(*keys).agg(F.stddev_samp(pred).alias(f"__std_{name}"))
        out = join_table(out, table, keys, spec)
    overall = scalars(df, F.stddev_samp(pred).alias("s"))["s"]
    names = [f"__std_{n}" for n in scopes(spec)]
    std = F.coalesce(*names, overall)
    on = truth(F.col(missing).cast("boolean"))
    return out.withColumns(
        {"std_used": std, pred: F.when(on, F.col(pred) + mult * std).otherwise(F.col(pred))}
    ).drop(*names)


def impute_from(pred: str, alt: str, missing_count: str, at_least: int = 1) -> Column:
    """The alternative prediction where enough weather columns are missing."""
    return F.when(F.col(missing_count) >= at_least, F.col(alt)).otherwise(F.col(pred))


def gate_weight(prob: Column | str, tau: float, mode: str) -> Column:
    p = num(prob)
    if mode == "hard":
        return flag(p >= tau).cast("double")
    if mode == "soft":
        return clip((p - tau) / max(1.0 - tau, 1e-6), 0.0, 1.0)
    raise ValueError(f"unknown mode: {mode}")


def gate_blend(
    normal: str, expert: str, prob: str, tau: float, mode: str, limit: float | None = None
) -> Column:
    """normal + gate weight times the (limited) step to the expert."""
    step = F.col(expert) - F.col(normal)
    if limit is not None and limit > 0:
        step = clip(step, -limit, limit)
    return F.col(normal) + gate_weight(prob, tau, mode) * step


def uplift_cap(train: DataFrame, uplift: str, q: float, spec: PanelSpec) -> Column:
    """Training quantile of the absolute uplift, 0.95 where that is not positive, >= 1e-3."""
    size = F.abs(F.col(uplift))
    t = row_scalars(quantiles(train, [], {"a": (size, q), "b": (size, 0.95)}, spec))
    return F.greatest(
        F.coalesce(F.when(t["a"] > 0, t["a"]).otherwise(t["b"]), F.lit(1.0)), F.lit(1e-3)
    )


def power_gate_uplift(
    base: str, prob: str, uplift: str, power: float, cap: Column | float
) -> Column:
    """base + clip(p, 0, 1)^power times the uplift within +-cap."""
    cap = num(cap)
    gate = F.pow(clip(prob, 0.0, 1.0), F.lit(float(power)))
    return F.col(base) + gate * clip(uplift, -cap, cap)


def side_size(p_neg: str, pos: str, neg: str) -> Column:
    """(1 - p) max(pos, 0) - p max(neg, 0)."""
    p = F.col(p_neg)
    return (1.0 - p) * positive(pos) - p * positive(neg)


def hour_shrink_adjust(
    pred: str, adjustment: str, n: str, min_rows: int, weight: float
) -> Column:
    """pred + weight * n / (n + min_rows) * adjustment; no adjustment counts as 0."""
    rows = F.coalesce(F.col(n), F.lit(0))
    share = rows / (rows + F.lit(float(max(min_rows, 1))))
    return F.col(pred) + weight * share * F.coalesce(F.col(adjustment), F.lit(0.0))
