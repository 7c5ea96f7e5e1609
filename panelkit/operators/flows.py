"""Forecasts put together from the operators: several models, a gate, weights and calibration as one.

Each flow is fitted on training rows and gives an object that predicts any rows with the same columns.
Fits over all entities share their jobs; what a flow holds are models, small tables and scalars."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import clip, rmse, truth
from panelkit.operators import blend, model
from panelkit.operators.folds import recent_holdout
from panelkit.operators.joins import assert_same_ids
from panelkit.plans.layout import PanelSpec
from panelkit.plans.ranks import quantiles
from panelkit.sources.io import complete_predictions, materialize

# --- a model, its fallback and a gated uplift ----------------------------------------------


@dataclass(frozen=True)
class SpikeFallback:
    """The full model, another where its inputs are missing, and an uplift as far as the gate is sure."""

    full: model.GlobalModel
    fallback: model.GlobalModel
    gate: model.Gate
    uplift: model.GlobalModel
    cap: float
    missing: str
    power: float

    def baseline(self, df: DataFrame) -> DataFrame:
        """Rows with ``base`` and ``prob``."""
        both = self.fallback.predict(self.full.predict(df, "__full"), "__fallback")
        gone = truth(F.col(self.missing).cast("int") == 1)
        out = both.withColumn("base", F.when(gone, F.col("__fallback")).otherwise(F.col("__full")))
        return self.gate.predict(out.drop("__full", "__fallback"), "prob")

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        scored = self.uplift.predict(self.baseline(df), "uplift")
        return scored.withColumn(out, blend.power_gate_uplift("base", "prob", "uplift", self.power, self.cap))


def fit_spike_fallback(
    train: DataFrame,
    x: Sequence[str],
    fallback_x: Sequence[str],
    missing: str,
    spec: PanelSpec,
    cats: Sequence[str] = (),
    family: str = "gbt",
    power: float = 1.0,
    cap_quantile: float = 0.95,
    tail: float = 0.95,
    focus_rows: int = 300,
    gate_family: str = "logistic",
    **params,
) -> SpikeFallback:
    """Full model on ``x``; fallback, gate of the entity's upper tail and uplift of the residual on
    ``fallback_x``, which must be known where ``missing`` is 1. The uplift is held within its training
    quantile of size."""
    y = spec.target
    full = model.fit_global(train, x, y, family, spec, cats, **params)
    fallback = model.fit_global(train, fallback_x, y, family, spec, cats, **params)
    labelled = model.tail_labels(train, "upper", spec, tail)
    gate = model.fit_gate(labelled, fallback_x, "tail_label", spec, gate_family, cats)
    # What the uplift learns from needs the others, so they predict before it is fitted.
    first = SpikeFallback(full, fallback, gate, full, 1.0, missing, power)
    based = materialize(first.baseline(train))
    uplift = model.fit_uplift(based, fallback_x, spec, "base", "prob", family, focus_rows, **params)
    size = F.abs(F.col("uplift"))
    q = quantiles(uplift.predict(based, "uplift"), [], {"a": (size, cap_quantile), "b": (size, 0.95)}, spec).first()
    cap = max(next((v for v in (q["a"], q["b"]) if v is not None and v > 0), 1.0), 1e-3)
    return SpikeFallback(full, fallback, gate, uplift, cap, missing, power)


# --- families, globally and per entity -----------------------------------------------------


@dataclass(frozen=True)
class FamilyEnsemble:
    """Global models of several families; per entity further models that also see the global mean."""

    tops: dict[str, model.GlobalModel]
    locals_: dict[str, model.LocalModels]
    weights: dict[str, float]
    spec: PanelSpec
    peers: tuple[Sequence[str], DataFrame] | None = None
    lookback: int = 168

    def families(self, df: DataFrame) -> DataFrame:
        """Rows with ``global_pred`` and a column ``pred_<family>`` each."""
        rows = _global_mean(df, self.tops, self.weights)
        if self.peers:
            rows = _with_peers(rows, self.peers, self.spec, self.lookback)
        for name, local in self.locals_.items():
            rows = local.predict(rows, f"pred_{name}")
        return rows

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        total = sum((F.col(f"pred_{name}") * F.lit(w) for name, w in self.weights.items()), F.lit(0.0))
        return self.families(df).withColumn(out, total)


def _global_mean(df: DataFrame, tops: Mapping[str, model.GlobalModel], weights: Mapping[str, float]) -> DataFrame:
    for name, top in tops.items():
        df = top.predict(df, f"__top_{name}")
    total = sum((F.col(f"__top_{name}") * F.lit(w) for name, w in weights.items()), F.lit(0.0))
    return df.withColumn("global_pred", total).drop(*[f"__top_{name}" for name in tops])


PEER = ("peer_mean", "peer_median", "peer_std", "peer_corr_signal", "peer_corr_strength")


def _with_peers(df: DataFrame, peers: tuple[Sequence[str], DataFrame], spec: PanelSpec, lookback: int) -> DataFrame:
    names, history = peers
    rows = model.peer_features(df, spec, names, history, "global_pred", lookback)
    return rows.select(*df.columns, *PEER)


def fit_family_ensemble(
    train: DataFrame,
    x: Sequence[str],
    families: Mapping[str, Mapping],
    spec: PanelSpec,
    cats: Sequence[str] = (),
    weights: Mapping[str, float] | None = None,
    locals_: Mapping[str, Mapping] | None = None,
    peers: Sequence[str] | None = None,
    lookback: int = 168,
) -> FamilyEnsemble:
    """``families`` and ``locals_`` map a family to its parameters; ``weights`` (equal by default) count for
    both levels and are normalised. With ``peers``, the named entities, local models also see what the others'
    global predictions say."""
    share = blend.normalized([float((weights or {}).get(f, 0.0 if weights else 1.0)) for f in families])
    shares = dict(zip(families, share))
    tops = {f: model.fit_global(train, x, spec.target, f, spec, cats, **params) for f, params in families.items()}
    rows = _global_mean(train, tops, shares)
    seen = (peers, train) if peers else None
    if seen:
        rows = _with_peers(rows, seen, spec, lookback)
    rows = materialize(rows)
    local_x = [*x, *(PEER if seen else ())]
    fitted = {
        f: model.fit_local(rows, local_x, spec.target, spec, f, **(locals_ or {}).get(f, {})) for f in families
    }
    return FamilyEnsemble(tops, fitted, shares, spec, seen, lookback)


# --- weights from out-of-fold errors -------------------------------------------------------


def oof_weights(oof: Mapping[str, DataFrame], spec: PanelSpec, power: float = 2.0, pred: str = "pred") -> dict[str, float]:
    """Weight of each model by its out-of-fold error over the rows that all models predict."""
    wide = None
    for name, df in oof.items():
        # Rows of several folds count once, with the latest fold's prediction.
        last = F.max_by(pred, "fold") if "fold" in df.columns else F.max(pred)
        part = df.groupBy(spec.id).agg(last.alias(f"__{name}"), F.max(spec.target).alias("__y"))
        wide = part if wide is None else wide.join(part.drop("__y"), spec.id)
    full = wide.dropna(subset=["__y", *[f"__{n}" for n in oof]])
    errors = full.agg(*[rmse(F.col(f"__{n}") - F.col("__y")).alias(n) for n in oof])
    table = errors.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("rmse")) for n in oof])))
    return {r["name"]: r["weight"] for r in blend.inverse_error_weights(table, power=power).collect()}


# --- calibration on a recent holdout -------------------------------------------------------

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Calibrated:
    """A predictor fitted on all rows, the bias it had on the latest ones, and the range of targets."""

    predict_rows: Callable[[DataFrame], DataFrame]
    bias: DataFrame
    bounds: tuple[DataFrame, DataFrame, DataFrame]
    errors: dict = field(default_factory=dict)
    spec: PanelSpec = field(default_factory=PanelSpec)

    def predict(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        """Predictions with the bias of their (entity, hour) added and held in the guardrail; ``was_clipped``
        tells where it acted. Rows need ``hour``."""
        shifted = blend.peak_bias_apply(self.predict_rows(df), self.bias, self.spec, pred)
        return blend.guardrail_apply(shifted, self.bounds, self.spec, pred)


def fit_calibrated(
    df: DataFrame,
    fit: Fit,
    spec: PanelSpec,
    days: int = 14,
    hours: Sequence[int] = tuple(range(24)),
    min_rows: int = 3,
    low: float = 0.001,
    high: float = 0.999,
    pred: str = "pred",
) -> Calibrated:
    """Fit on all but the last ``days`` days, take the mean error per (entity, hour) on those, then fit again on
    everything. ``fit(train)`` returns a function that adds ``pred`` to rows. Raises without rows on
    either side of the cutoff."""
    known = materialize(recent_holdout(df.filter(F.col(spec.target).isNotNull()), spec, days))
    train, held = (known.filter(F.col("role") == role).drop("role") for role in ("train", "holdout"))
    counts = {r["role"]: r["n"] for r in known.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get("train") or not counts.get("holdout"):
        raise ValueError(f"too few rows around the cutoff: {counts}")
    scored = materialize(fit(train)(held))
    bias = materialize(blend.peak_bias_fit(scored, spec, hours, min_rows, pred))
    bounds = blend.guardrail_fit(known.drop("role"), spec, low, high)
    row = scored.agg(rmse(F.col(pred) - F.col(spec.target)).alias("holdout_rmse")).first()
    return Calibrated(fit(known.drop("role")), bias, bounds, row.asDict() | counts, spec)


# --- final ensemble ------------------------------------------------------------------------


def final_ensemble(
    preds: Mapping[str, DataFrame], weights: Mapping[str, float], expected: DataFrame, lower: Column | float | None = None
) -> DataFrame:
    """(id, target) of exactly the expected ids: the weighted mean of prediction tables that all hold the
    same ids. Fails if ids differ or an expected one is missing."""
    if set(preds) != set(weights):
        raise ValueError(f"tables and weights differ: {sorted(set(preds) ^ set(weights))}")
    assert_same_ids(preds)
    mean = blend.weighted_average(preds, [weights[name] for name in preds])
    if lower is not None:
        mean = mean.withColumn("target", clip("target", low=lower))
    return complete_predictions(mean, expected)
