"""Recursive forecasts from several models: each step's mixed prediction feeds the next steps.

Histories and the first rows of the horizon are gathered per entity, bounded by the longest lag or
window and the number of steps; tasks then take that many steps for all entities of an Arrow batch at once.
Models of all entities go to the workers as flat arrays; models per entity that are linear travel with
the entity's row."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.operators.model import (
    LAG_STEPS,
    ROLL_WINDOWS,
    Gate,
    GlobalModel,
    edge_rows,
    history_features,
)
from panelkit.operators.profile import join_table
from panelkit.plans.gram import LIMIT
from panelkit.plans.layout import PanelSpec
from panelkit.plans.trees import GroupTrees, Trees, flatten

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LinearModels:
    """A ridge table per entity and the features it was fitted on."""

    table: DataFrame
    x: list[str]


Model = GlobalModel | Gate | GroupTrees | LinearModels | float


@dataclass(frozen=True)
class Mixture:
    """What a step predicts: (1 - p) normal + p spike, with p from the gate."""

    normal: Model
    spike: Model | None = None
    gate: Model = 0.15


@dataclass(frozen=True)
class _Scorer:
    """A model as arrays. ``numbers`` and ``texts`` are columns of the step, by name."""

    x: list[str]
    cats: list[str] = field(default_factory=list)
    fills: np.ndarray | None = None
    modes: list[str] = field(default_factory=list)
    labels: list[list[str]] = field(default_factory=list)
    trees: Trees | None = None
    coefs: np.ndarray | None = None
    intercept: float = 0.0
    link: str = "identity"
    groups: GroupTrees | None = None
    linear: str | None = None
    constant: float | None = None

    def score(self, numbers: dict, texts: dict, entity: np.ndarray, own: dict) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(entity), self.constant)
        x = np.column_stack([numbers[c] for c in self.x]) if self.x else np.zeros((len(entity), 0))
        if self.groups is not None:
            out = np.full(len(entity), np.nan)
            for i, name in enumerate(entity):
                out[i] = self.groups.score(name, x[i : i + 1])[0]
            return out
        if self.linear is not None:
            intercept, coefs, fills = own[self.linear]
            held = np.clip(np.where(np.isfinite(x), x, fills), -LIMIT, LIMIT)
            return intercept + (coefs * held).sum(1)
        x = np.where(np.isnan(x), self.fills, x)
        hot = [x]
        for c, mode, labels in zip(self.cats, self.modes, self.labels):
            place = {v: i for i, v in enumerate(labels)}
            at = np.array([place.get(mode if v is None else v, -1) for v in texts[c]])
            hot.append((at[:, None] == np.arange(len(labels))).astype(float))
        x = np.hstack(hot)
        margin = self.trees.walk(x) if self.trees else self.intercept + x @ self.coefs
        if self.link == "identity":
            return margin
        return 1.0 / (1.0 + np.exp(-margin * (2.0 if self.link == "boosted" else 1.0)))


def _scorer(model: Model, name: str) -> _Scorer:
    if isinstance(model, Gate):
        model = model.model if model.model is not None else model.default
    if isinstance(model, (int, float)):
        return _Scorer([], constant=float(model))
    if isinstance(model, GroupTrees):
        return _Scorer(model.x, groups=model)
    if isinstance(model, LinearModels):
        return _Scorer(list(model.x), linear=name)
    stages = model.pipeline.stages
    last = stages[-1]
    kind = type(last).__name__
    # A category seen in the fit has a column; the one kept for unknown values has none.
    labels = [list(stages[i].labelsArray[0]) for i in range(len(model.cats))]
    common = {
        "x": model.x, "cats": model.cats, "fills": np.array([model.fills[c] for c in model.x], float),
        "modes": [model.modes[c] for c in model.cats], "labels": labels,
    }
    if kind == "GBTClassificationModel":
        return _Scorer(**common, trees=flatten(last), link="boosted")
    if kind in ("GBTRegressionModel", "RandomForestRegressionModel"):
        return _Scorer(**common, trees=flatten(last))
    link = "logistic" if kind == "LogisticRegressionModel" else "identity"
    return _Scorer(**common, coefs=last.coefficients.toArray(), intercept=float(last.intercept), link=link)


def _histories(arrays: Sequence, keep: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Past values of all entities, right-aligned at ``keep`` with room for the steps, and how many each has."""
    held = np.full((len(arrays), keep + steps), np.nan)
    known = np.zeros(len(arrays), int)
    for i, past in enumerate(arrays):
        past = np.asarray(past if past is not None else [], float)[-keep:]
        known[i] = len(past)
        held[i, keep - len(past) : keep] = past
    return held, known


def _features(held: np.ndarray, known: np.ndarray, at: int, lag_steps, windows) -> dict:
    """History features before position ``at``: lags, and mean and sample std (0 of one value) of the last values."""
    out = {}
    for lag in lag_steps:
        out[f"target_lag_{lag}"] = np.where(known >= lag, held[:, at - lag] if at >= lag else np.nan, np.nan)
    for n in windows:
        tail = held[:, max(0, at - n) : at]
        size = np.minimum(known, n)
        inside = np.arange(tail.shape[1])[None, :] >= tail.shape[1] - size[:, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(inside, tail, 0.0).sum(1) / size
            off = np.where(inside, tail - mean[:, None], 0.0)
            std = np.sqrt((off * off).sum(1) / (size - 1))
        out[f"target_roll_mean_{n}"] = np.where(size > 0, mean, np.nan)
        out[f"target_roll_std_{n}"] = np.where(size > 1, std, np.where(size == 1, 0.0, np.nan))
    return out


def recursive_mixture(
    hist: DataFrame,
    horizon: DataFrame,
    models: Mixture,
    spec: PanelSpec,
    steps: int = 12,
    mid: str | None = None,
    far: str | None = None,
    mid_steps: int = 48,
    lag_steps: Sequence[int] = LAG_STEPS,
    windows: Sequence[int] = ROLL_WINDOWS,
) -> DataFrame:
    """(id, ts, entity, pred, part): the first ``steps`` rows of each entity's horizon (part ``near``) are
    predicted one by one, each prediction joining the history; the next ``mid_steps`` take the column ``mid``
    where one is named, and all later ones ``far``, or are left out without it.

    Models ask for history features by the names of ``history_features`` and for columns of the horizon. A
    feature that is missing takes the model's fill value; a step without a prediction (an entity without a
    linear model) gives NULL and leaves its place in the history empty."""
    e, keep = spec.entity, max([*lag_steps, *windows])
    past_names = set(history_features(lag_steps, windows))
    parts = {"normal": models.normal, "spike": models.spike, "gate": models.gate if models.spike is not None else None}
    parts = {k: v for k, v in parts.items() if v is not None}
    scorers = {k: _scorer(m, k) for k, m in parts.items()}
    static = sorted({c for s in scorers.values() for c in s.x} - past_names)
    cats = sorted({c for s in scorers.values() for c in s.cats})

    place = F.row_number().over(W.partitionBy(e).orderBy(*spec.order))
    early = edge_rows(horizon, spec, steps + (mid_steps if mid is not None else 0), newest=False)
    early = early.withColumn("__place", place)  # of a bounded number of rows an entity
    past = (
        edge_rows(hist.filter(F.col(spec.target).isNotNull()), spec, keep, newest=True)
        .groupBy(e)
        .agg(F.array_sort(F.collect_list(F.struct(spec.ts, spec.id, spec.target))).alias("__h"))
        .select(e, F.transform("__h", lambda r: r[spec.target].cast("double")).alias("__hist"))
    )
    row = F.struct(
        F.col(spec.ts), F.col(spec.id),
        F.array(*[F.col(c).cast("double") for c in static]).cast("array<double>").alias("__x"),
        F.array(*[F.col(c).cast("string") for c in cats]).cast("array<string>").alias("__c"),
    )
    packed = early.filter(F.col("__place") <= steps).groupBy(e).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    state = join_table(packed, past, [e], spec)
    linear = [k for k, m in parts.items() if isinstance(m, LinearModels)]
    for k in linear:
        own = parts[k].table.select(e, *[F.col(c).alias(f"__{k}_{c}") for c in ("intercept", "coefs", "fills")])
        state = join_table(state, own, [e], spec)
    kind, ident, when = dict(horizon.dtypes), spec.id, spec.ts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            entity = batch[e].to_numpy(dtype=object)
            held, known = _histories(batch["__hist"], keep, steps)
            own = {}
            for k in linear:
                size = len(scorers[k].x)
                blank = np.full(size, np.nan)
                own[k] = (
                    batch[f"__{k}_intercept"].to_numpy(dtype=float, na_value=np.nan),
                    np.array([blank if a is None else np.asarray(a, float) for a in batch[f"__{k}_coefs"]]).reshape(n, size),
                    np.array([blank if a is None else np.asarray(a, float) for a in batch[f"__{k}_fills"]]).reshape(n, size),
                )
            rows = [list(r) for r in batch["__rows"]]
            values = np.full((steps, n, len(static)), np.nan)
            words = [[[None] * n for _ in cats] for _ in range(steps)]
            for i, some in enumerate(rows):
                for s, r in enumerate(some):
                    values[s, i] = [np.nan if v is None else v for v in r["__x"]]
                    for j, w in enumerate(r["__c"]):
                        words[s][j][i] = w
            out = np.full((n, steps), np.nan)
            for s in range(steps):
                at = keep + s
                numbers = dict(zip(static, values[s].T)) | _features(held, known, at, lag_steps, windows)
                texts = dict(zip(cats, words[s]))
                said = {k: m.score(numbers, texts, entity, own) for k, m in scorers.items()}
                mixed = said["normal"]
                if "spike" in said:
                    mixed = (1.0 - said["gate"]) * said["normal"] + said["gate"] * said["spike"]
                out[:, s] = held[:, at] = mixed
                known = np.minimum(known + 1, keep)
            near = [(name, r[ident], r[when], out[i, s]) for i, name in enumerate(entity) for s, r in enumerate(rows[i])]
            made = pd.DataFrame(near, columns=[e, ident, when, "pred"])
            yield made.astype({e: object, "pred": object}).where(made.notna(), None)

    near = state.mapInPandas(
        run, f"`{e}` {kind[e]}, `{spec.id}` {kind[spec.id]}, `{spec.ts}` {kind[spec.ts]}, pred double"
    ).select(spec.id, spec.ts, e, "pred", F.lit("near").alias("part"))
    out = near
    if mid is not None:
        some = early.filter(F.col("__place") > steps)
        out = out.unionByName(some.select(spec.id, spec.ts, e, F.col(mid).cast("double").alias("pred"), F.lit("mid").alias("part")))
    if far is not None:
        rest = horizon.join(early.select(spec.id), spec.id, "left_anti")
        out = out.unionByName(rest.select(spec.id, spec.ts, e, F.col(far).cast("double").alias("pred"), F.lit("far").alias("part")))
    return out
