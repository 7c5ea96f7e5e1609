"""Model fits on the panel.

Linear models come from sums of products (``gram``) and are solved per group inside tasks; trees
and classifiers use ``pyspark.ml``. Only fold bounds, small matrices and importance rows reach
the driver. Predictions are always keyed by id."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import clip, flag, rmse, safe_corr, truth, wall_clock
from panelkit.operators.blend import tail_quantiles
from panelkit.operators.profile import join_table, summarize, table_bound
from panelkit.operators.window import rolling_pair_corr
from panelkit.plans.gram import LIMIT, gram, pair_correlations, ridge_solution, square
from panelkit.plans.layout import PanelSpec, attach, row_scalars, scalars, time_bucket
from panelkit.plans.ranks import positions, quantiles
from panelkit.plans.trees import GroupTrees, grow
from panelkit.sources.io import materialize

# --- linear fits ---------------------------------------------------------------------------


def _finite(c: str) -> Column:
    """The value as double, NULL where it is NaN or infinite."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _filled(c: str, fill: Column) -> Column:
    return clip(F.coalesce(_finite(c), fill), -LIMIT, LIMIT)


def grouped_ridge(
    df: DataFrame,
    by: Sequence[str],
    x: Sequence[str],
    y: str,
    spec: PanelSpec,
    alpha: float = 25.0,
    min_rows: int = 1,
) -> DataFrame:
    """Ridge on standardised features with a free intercept, one model per group.

    Missing, NaN and infinite features take the group's median (0 where it has none) and are held within +-1e7.
    Returns (by, n, mean_y, intercept, coefs, fills); a group whose system cannot be solved
    predicts its mean.
    """
    by, k = list(by), len(x)
    df = df.filter(F.col(y).isNotNull()).select(*by, y, *x)
    medians = {f"__m{i}": (_finite(c), 0.5) for i, c in enumerate(x)}
    means = {"mean_y": F.avg(y), "n": F.count(y)}
    fills = F.array(*[F.coalesce(m, F.lit(0.0)) for m in medians]).alias("fills")
    known = materialize(
        summarize(df, by, means, medians, spec)
        .filter(F.col("n") >= min_rows)
        .select(*by, *means, fills)
    )

    # Sums are taken around the fill value and the mean of y, which keeps them well scaled.
    rows = _with(df, known, by, spec, how="inner")
    shifted = [
        _filled(c, F.col("fills")[i]) - clip(F.col("fills")[i], -LIMIT, LIMIT)
        for i, c in enumerate(x)
    ]
    moments = gram(rows, by, [*shifted, F.col(y) - F.col("mean_y")])
    table = _with(moments, known, by, spec)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in table.select(*by).schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [
                ridge_solution(tri, fill, mean, k, alpha)
                for tri, fill, mean in zip(batch["gram"], batch["fills"], batch["mean_y"])
            ]
            out = batch[[*by, "n", "mean_y", "fills"]].copy()
            out["intercept"] = [m[0] for m in made]
            out["coefs"] = [m[1] for m in made]
            yield out

    return table.mapInPandas(
        solve,
        keys + "n bigint, mean_y double, fills array<double>, intercept double, coefs array<double>",
    )


def _with(
    df: DataFrame, table: DataFrame, by: Sequence[str], spec: PanelSpec, how: str = "left"
) -> DataFrame:
    """Attach a table of one row per group, or of one row in all where there are no groups."""
    if by:
        return attach(df, table, by, table_bound(spec, by), how)
    return df.withColumns(row_scalars(table))


def linear_score(x: Sequence[str], intercept: Column, coefs: Column, fills: Column) -> Column:
    return sum((coefs[i] * _filled(c, fills[i]) for i, c in enumerate(x)), intercept)


def predict_ridge(
    df: DataFrame,
    table: DataFrame,
    by: Sequence[str],
    x: Sequence[str],
    spec: PanelSpec,
    out: str = "pred",
    fallback: Column | str | None = None,
) -> DataFrame:
    """Linear prediction of each row's group; ``fallback`` (else NULL) for unknown groups."""
    names = ["intercept", "coefs", "fills", "mean_y"]
    own = table.select(*by, *[F.col(n).alias(f"__{n}") for n in names])
    rows = _with(df, own, by, spec)
    score = linear_score(x, F.col("__intercept"), F.col("__coefs"), F.col("__fills"))
    score = F.when(F.isnan(score), F.col("__mean_y")).otherwise(score)
    if fallback is not None:
        score = F.coalesce(score, F.col(fallback) if isinstance(fallback, str) else fallback)
    return rows.withColumn(out, score).drop(*[f"__{n}" for n in names])


# --- stacking weights ----------------------------------------------------------------------


def nonneg_weights(xtx: np.ndarray, xty: np.ndarray, lam: float) -> np.ndarray:
    """Ridge without intercept, negatives cut, scaled to sum 1; equal if all are cut. Of the
    solutions of a singular system the shortest."""
    k = len(xty)
    kept = np.maximum(np.linalg.lstsq(xtx + np.diag(np.full(k, lam)), xty, rcond=None)[0], 0.0)
    total = float(kept.sum())
    return np.ones(k) / k if total <= 0 else kept / total


def nonneg_stack(
    oof: DataFrame, models: Sequence[str], lam: float, y: str = "target"
) -> DataFrame:
    """(model, weight, rmse) of the stacked models."""
    k = len(models)
    g = square(gram(oof.dropna(subset=[y, *models]), [], [*models, y]).first()[0], k + 2)
    xtx, xty, yy = g[1 : k + 1, 1 : k + 1], g[1 : k + 1, k + 1], g[k + 1, k + 1]
    w = nonneg_weights(xtx, xty, lam)
    own = np.sqrt(np.maximum(yy - 2 * xty + np.diag(xtx), 0.0) / g[0, 0])
    rows = [(m, float(a), float(r)) for m, a, r in zip(models, w, own)]
    return oof.sparkSession.createDataFrame(rows, "model string, weight double, rmse double")


def lambda_search(
    oof: DataFrame,
    models: Sequence[str],
    lambdas: Sequence[float],
    folds: DataFrame,
    spec: PanelSpec,
) -> DataFrame:
    """Walk-forward rmse per lambda, weighted by validation rows, best first.

    Rows are cut into the stretches between fold bounds; one aggregate gives the products of
    every stretch, and a fold's training part is the sum of the stretches before it. Without
    folds the whole table is used for both.
    """
    y, k = spec.target, len(models)
    bounds = folds.orderBy("fold").collect()
    edges = [r["val_start"] for r in bounds] + [bounds[-1]["val_end"]] if bounds else []
    part = F.lit(0)
    for edge in edges:
        part = part + flag(F.col(spec.ts) >= wall_clock(edge))
    rows = oof.dropna(subset=[y, *models]).withColumn("__part", part)
    table = {r["__part"]: square(r["gram"], k + 2) for r in gram(rows, ["__part"], [*models, y]).collect()}
    zero = np.zeros((k + 2, k + 2))

    def split(g: np.ndarray):
        return g[1 : k + 1, 1 : k + 1], g[1 : k + 1, k + 1], g[k + 1, k + 1], g[0, 0]

    if bounds:
        cuts = [
            (sum((table.get(j, zero) for j in range(i + 1)), zero), table.get(i + 1, zero))
            for i in range(len(bounds))
        ]
        cuts = [(a, b) for a, b in cuts if a[0, 0] > 0 and b[0, 0] > 0]
    else:
        cuts = [(table.get(0, zero), table.get(0, zero))]
    scores = []
    for lam in lambdas:
        total, count = 0.0, 0.0
        for train, val in cuts:
            w = nonneg_weights(*split(train)[:2], lam)
            xtx, xty, yy, n = split(val)
            total += np.sqrt(max(yy - 2 * w @ xty + w @ xtx @ w, 0.0) / n) * n
            count += n
        scores.append((float(lam), float(total / count)))
    scores.sort(key=lambda r: (r[1], r[0]))
    mode = "time_walk_forward" if bounds else "full_oof_no_time_folds"
    return oof.sparkSession.createDataFrame(
        [(lam, s, mode, len(bounds)) for lam, s in scores],
        "lambda double, rmse_cv double, mode string, n_folds int",
    )


def corr_prune(
    oof: DataFrame, models: Sequence[str], threshold: float, y: str = "target"
) -> tuple[list[str], DataFrame]:
    """Models kept, and (step, dropped, kept, pair_corr, rmse_dropped, rmse_kept): the worse
    model of the most correlated pair goes until no pair exceeds the threshold."""
    strength = np.nan_to_num(np.abs(pair_correlations(oof, models)))
    errors = oof.agg(*[rmse(F.col(m) - F.col(y)).alias(m) for m in models]).first()
    above = [(i, j) for i, j in combinations(range(len(models)), 2) if strength[i, j] > threshold]
    gone: set[int] = set()
    drops = []
    # Strongest pair first; a pair that lost a member has nothing left to settle.
    for i, j in sorted(above, key=lambda p: (-strength[p], p)):
        if gone & {i, j}:
            continue
        worse, better = sorted((i, j), key=lambda m: (-errors[models[m]], -m))
        gone.add(worse)
        pair = (models[worse], models[better])
        drops.append((len(drops) + 1, *pair, float(strength[i, j]), *[errors[m] for m in pair]))
    table = oof.sparkSession.createDataFrame(
        drops,
        "step int, dropped string, kept string, pair_corr double, rmse_dropped double, rmse_kept double",
    )
    return [m for i, m in enumerate(models) if i not in gone], table


# --- global and local models ---------------------------------------------------------------

FAMILIES = ("gbt", "forest", "ridge", "lasso")


@dataclass(frozen=True)
class GlobalModel:
    """A fitted pipeline with the fill values it expects."""

    pipeline: PipelineModel
    x: list[str]
    cats: list[str]
    fills: dict[str, float]
    modes: dict[str, str] = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "pred", keep: str = "prediction") -> DataFrame:
        names = df.columns
        ready = _impute(df, self.x, self.cats, self.fills, self.modes)
        scored = self.pipeline.transform(ready)
        value = (
            vector_to_array("probability")[1] if keep == "probability" else F.col("prediction")
        )
        return scored.select(*[F.col(c) for c in names if c != out], value.alias(out))


def _impute(df, x, cats, fills, modes) -> DataFrame:
    made = {f"__n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) for c in x}
    made |= {f"__c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(modes[c])) for c in cats}
    return df.withColumns(made)


def _fit_pipeline(
    df: DataFrame, x: Sequence[str], cats: Sequence[str], y: str, estimator, spec: PanelSpec
) -> GlobalModel:
    """Median / most frequent fill, one-hot categories, assembled features, then the estimator."""
    x, cats = list(x), list(cats)
    rows = df.filter(F.col(y).isNotNull())
    med = quantiles(rows, [], {f"m{i}": (F.col(c).cast("double"), 0.5) for i, c in enumerate(x)}, spec)
    row = med.first()
    fills = {c: float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(x)}
    modes = {}
    for c in cats:
        top = (
            rows.filter(F.col(c).isNotNull())
            .groupBy(c)
            .count()
            .orderBy(F.col("count").desc(), F.col(c))
            .first()
        )
        modes[c] = str(top[0]) if top else "missing"
    inputs = [f"__n_{c}" for c in x] + [f"__o_{c}" for c in cats]
    stages = [
        *[
            StringIndexer(
                inputCol=f"__c_{c}", outputCol=f"__i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"
            )
            for c in cats
        ],
        *[OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}") for c in cats],
        VectorAssembler(inputCols=inputs, outputCol="features"),
        estimator,
    ]
    ready = _impute(rows.withColumn("__y", F.col(y).cast("double")), x, cats, fills, modes)
    return GlobalModel(Pipeline(stages=stages).fit(ready), x, cats, fills, modes)


def fit_global(
    df: DataFrame,
    x: Sequence[str],
    y: str,
    family: str,
    spec: PanelSpec,
    cats: Sequence[str] = (),
    **params,
) -> GlobalModel:
    """One model over all entities: ``gbt``, ``forest``, ``ridge`` or ``lasso``.

    Defaults: ridge has a penalty of 1 on the sum of squared errors (which divides by the number of
    rows here), lasso 1e-4 on their mean; forests have two rows per leaf or more."""
    if family == "ridge" and "regParam" not in params:
        params["regParam"] = 1.0 / max(1, df.filter(F.col(y).isNotNull()).count())
    made = {
        "gbt": lambda: GBTRegressor(labelCol="__y", seed=42, **params),
        "forest": lambda: RandomForestRegressor(
            labelCol="__y", seed=42, **{"minInstancesPerNode": 2, **params}
        ),
        "ridge": lambda: LinearRegression(
            labelCol="__y", elasticNetParam=0.0, **params
        ),
        "lasso": lambda: LinearRegression(
            labelCol="__y", elasticNetParam=1.0, **{"regParam": 1e-4, **params}
        ),
    }
    if family not in made:
        raise ValueError(f"unknown family {family}, expected one of {FAMILIES}")
    return _fit_pipeline(df, x, cats, y, made[family](), spec)


@dataclass(frozen=True)
class LocalModels:
    """Models per entity on the features plus the global prediction."""

    x: list[str]
    spec: PanelSpec
    linear: DataFrame | None = None
    trees: GroupTrees | None = None
    residual: bool = False
    base: str = "global_pred"

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Local prediction, the global one for entities without a model, in one scan. With ``residual`` the
        local part is added to the global prediction."""
        e, base = self.spec.entity, F.col(self.base)
        if self.linear is not None:
            scored = predict_ridge(df, self.linear, [e], self.x, self.spec, "__local")
        else:
            scored = df.withColumn("__local", self.trees.column(df.sparkSession, F.col(e)))
        local = F.col("__local") + base if self.residual else F.col("__local")
        return scored.withColumn(out, F.coalesce(local, base)).drop("__local")


def fit_local(
    df: DataFrame,
    x: Sequence[str],
    y: str,
    spec: PanelSpec,
    family: str = "ridge",
    entities: Sequence[str] | None = None,
    base: str = "global_pred",
    residual: bool = False,
    alpha: float = 25.0,
    **params,
) -> LocalModels:
    """Model per entity: ``ridge``, or ``gbt`` or ``forest`` grown by ``plans.trees.grow``. All entities (or
    the named ones) are fitted in the same jobs."""
    cols = [*x, base]
    if entities is not None:
        df = df.filter(F.col(spec.entity).isin(*entities))
    if family == "ridge":
        table = materialize(grouped_ridge(df, [spec.entity], cols, y, spec, alpha))
        return LocalModels(cols, spec, linear=table, residual=residual, base=base)
    grown = grow(df, spec.entity, cols, y, spec, family, **params)
    return LocalModels(cols, spec, trees=grown, residual=residual, base=base)


# --- walk-forward --------------------------------------------------------------------------


def fold_bounds(folds: DataFrame) -> list[dict]:
    """The few fold rows on the driver, as wall-clock literals."""
    return [r.asDict() for r in folds.orderBy("fold").collect()]


def train_part(df: DataFrame, fold: Mapping, spec: PanelSpec) -> DataFrame:
    return df.filter(F.col(spec.ts) < wall_clock(fold["train_end"]))


def val_part(df: DataFrame, fold: Mapping, spec: PanelSpec) -> DataFrame:
    t = F.col(spec.ts)
    out = df.filter(t >= wall_clock(fold["val_start"]))
    if fold["val_end"] is not None:
        out = out.filter(t < wall_clock(fold["val_end"]))
    return out


def walk_forward(
    df: DataFrame,
    folds: DataFrame,
    spec: PanelSpec,
    fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Out-of-fold table (id, ts, entity, target, pred, fold).

    ``fit_predict(train, val)`` fits on the training rows only and returns the validation rows
    with ``pred``. Rows keep their id, so nothing depends on order.
    """
    out = None
    for fold in fold_bounds(folds):
        scored = fit_predict(train_part(df, fold, spec), val_part(df, fold, spec))
        part = scored.select(
            spec.id, spec.ts, spec.entity, spec.target, "pred", F.lit(fold["fold"]).alias("fold")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folds")
    return out


def global_oof(
    df: DataFrame, folds: DataFrame, x: Sequence[str], spec: PanelSpec, family: str, **params
) -> DataFrame:
    """(id, fold, pred) of a global model refitted before every fold."""

    def one(train: DataFrame, val: DataFrame) -> DataFrame:
        return fit_global(train, x, spec.target, family, spec, **params).predict(val)

    return walk_forward(df, folds, spec, one).select(spec.id, "fold", "pred")


def residual_stack(
    train: DataFrame,
    folds: DataFrame,
    x: Sequence[str],
    spec: PanelSpec,
    family: str = "ridge",
    alpha: float = 25.0,
    **params,
) -> tuple[GlobalModel, LocalModels]:
    """Global model plus local models of what its out-of-fold predictions leave over (its
    in-sample prediction where a row has no fold). ``LocalModels.predict`` adds both up."""
    top = fit_global(train, x, spec.target, family, spec, **params)
    rows = top.predict(train, "global_pred")
    oof = global_oof(train, folds, x, spec, family, **params)
    # Overlapping folds: the latest fold's prediction counts.
    last = oof.groupBy(spec.id).agg(F.max_by("pred", "fold").alias("__oof"))
    rows = attach(rows, last, [spec.id]).withColumn(
        "__rest", F.col(spec.target) - F.coalesce("__oof", "global_pred")
    )
    return top, fit_local(rows, x, "__rest", spec, residual=True, alpha=alpha)


# --- tails, gates, uplift ------------------------------------------------------------------


def tail_labels(
    df: DataFrame,
    mode: str,
    spec: PanelSpec,
    upper: float = 0.95,
    lower: float = 0.05,
    by_hour: bool = False,
    hour_min_rows: int = 1,
    out: str = "tail_label",
) -> DataFrame:
    """1 in the upper / two-sided / absolute tail of the entity's target. With ``by_hour`` an
    (entity, hour) with enough rows uses its own quantiles."""
    e, y = spec.entity, spec.target
    want = tail_quantiles(y, mode, upper, lower)
    # The fitted tables are stored: labels of labelled frames would otherwise double their plan each time.
    rows = join_table(df, materialize(quantiles(df, [e], want, spec)), [e], spec)
    names = list(want)
    if by_hour:
        own = {f"{n}_h": v for n, v in want.items()}
        cells = summarize(df, [e, "hour"], {"__size": F.count(F.lit(1))}, own, spec)
        cells = materialize(cells.filter(F.col("__size") >= hour_min_rows).drop("__size"))
        rows = join_table(rows, cells, [e, "hour"], spec)
        rows = rows.withColumns({n: F.coalesce(f"{n}_h", n) for n in want}).drop(*own)
    x = F.abs(F.col(y)) if mode == "abs" else F.col(y)
    hit = x >= F.col("__hi")
    if mode == "two_sided":
        hit = hit | (x <= F.col("__lo"))
    return rows.withColumn(out, flag(hit)).drop(*names)


# Sample weights of the upper and lower tail and of large absolute values.
TAIL_WEIGHTS = {"upper": 4.0, "lower": 3.0, "absolute": 5.0}


def tail_weights(df: DataFrame, spec: PanelSpec, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``spike_weight`` from the 5 / 95 % tails and ``peak_weight`` from the largest tenth of
    absolute targets, both within the entity."""
    w, y = {**TAIL_WEIGHTS, **(weights or {})}, F.col(spec.target)
    want = {"__u": (y, 0.95), "__l": (y, 0.05), "__a": (F.abs(y), 0.9)}
    rows = join_table(df, materialize(quantiles(df, [spec.entity], want, spec)), [spec.entity], spec)
    return rows.withColumns(
        {
            "spike_weight": F.when(y <= F.col("__l"), w["lower"])
            .when(y >= F.col("__u"), w["upper"])
            .otherwise(1.0),
            "peak_weight": F.when(F.abs(y) >= F.col("__a"), w["absolute"]).otherwise(1.0),
        }
    ).drop(*want)


def class_balance(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Weight max(1, negatives / positives) for positive rows, 1 for the others."""
    c = scalars(df, F.sum(label).alias("p"), F.count(label).alias("n"))
    ratio = (c["n"] - c["p"]) / F.greatest(c["p"], F.lit(1))
    return df.withColumn(
        out, F.when(F.col(label) == 1, F.greatest(ratio, F.lit(1.0))).otherwise(F.lit(1.0))
    )


@dataclass(frozen=True)
class Gate:
    """Probability of the labelled class, or a constant where it could not be fitted."""

    model: GlobalModel | None
    default: float

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.default))
        return self.model.predict(df, out, keep="probability")


def fit_gate(
    df: DataFrame,
    x: Sequence[str],
    label: str,
    spec: PanelSpec,
    family: str = "logistic",
    cats: Sequence[str] = (),
    min_class: int = 1,
    default: float = 0.15,
    **params,
) -> Gate:
    """Balanced classifier of ``label``; skipped when a class has fewer than ``min_class`` rows."""
    row = df.agg(F.sum(label), F.count(label)).first()
    pos, neg = int(row[0] or 0), int((row[1] or 0) - (row[0] or 0))
    if min(pos, neg) < max(min_class, 1):
        return Gate(None, default)
    common = {"labelCol": "__y", "weightCol": "class_weight"}
    if family == "logistic":
        estimator = LogisticRegression(**common, **{"regParam": 0.01, **params})
    elif family == "gbt":
        estimator = GBTClassifier(**common, seed=42, **params)
    else:
        raise ValueError(f"unknown family: {family}")
    return Gate(_fit_pipeline(class_balance(df, label), x, cats, label, estimator, spec), default)


def focus_mask(
    df: DataFrame,
    spec: PanelSpec,
    base: str,
    prob: str,
    min_rows: int = 300,
    out: str = "in_focus",
) -> DataFrame:
    """Rows with |target - base| in its top 5 % or probability in its top 10 %; the top 10 % of
    residuals alone if that is fewer than ``min_rows`` rows."""
    rest = F.abs(F.col(spec.target) - F.col(base))
    q = row_scalars(
        quantiles(
            df, [], {"r95": (rest, 0.95), "r90": (rest, 0.9), "p90": (F.col(prob), 0.9)}, spec
        )
    )
    wide = truth((rest >= q["r95"]) | (F.col(prob) >= q["p90"]))
    n = scalars(df.withColumn("__w", wide), F.count_if("__w").alias("n"))["n"]
    mask = F.when(n >= min_rows, wide).otherwise(truth(rest >= q["r90"]))
    return df.withColumn(out, mask.cast("int"))


def fit_uplift(
    df: DataFrame,
    x: Sequence[str],
    spec: PanelSpec,
    base: str,
    prob: str,
    family: str = "gbt",
    min_rows: int = 300,
    **params,
) -> GlobalModel:
    """Model of the residual on the rows in focus."""
    rows = focus_mask(df, spec, base, prob, min_rows).filter("in_focus = 1")
    rows = rows.withColumn("__rest", F.col(spec.target) - F.col(base))
    return fit_global(rows, x, "__rest", family, spec, **params)


# --- recursive forecast --------------------------------------------------------------------

# Target lags and rolling windows fed back by the recursive forecast.
LAG_STEPS = (1, 2, 24, 48, 168)
ROLL_WINDOWS = (24, 48, 168)
# Bucket widths (seconds) over which the edge of a long history is narrowed down.
EDGE_WIDTHS = (3600.0, 30 * 86400.0)


def history_features(lag_steps=LAG_STEPS, windows=ROLL_WINDOWS) -> list[str]:
    return [f"target_lag_{k}" for k in lag_steps] + [
        f"target_roll_{fn}_{n}" for n in windows for fn in ("mean", "std")
    ]


def edge_rows(df: DataFrame, spec: PanelSpec, n: int, newest: bool) -> DataFrame:
    """The first or last n rows of each entity.

    A long history is cut per time bucket, then per wider bucket, before its rows meet."""
    order = [c.desc() if newest else c.asc() for c in spec.order]
    widths: list[float] = []
    if not spec.bounded([spec.entity]):
        wider = [s for s in EDGE_WIDTHS if s > spec.bucket_seconds]
        widths = [spec.bucket_seconds, *wider]
    out = df
    for width in [*widths, None]:
        keys = [F.col(spec.entity)] + ([time_bucket(spec.ts, width)] if width else [])
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        out = out.withColumn("__r", place).filter(F.col("__r") <= n)
    return out.drop("__r")


def _tail_stats(hist: Column, n: int) -> tuple[Column, Column]:
    """Mean and sample std (0 for one value) of the last n values."""
    tail = F.slice(hist, F.greatest(F.size(hist) - n + 1, F.lit(1)), F.lit(n))
    size = F.size(tail)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / size
    sq = F.aggregate(tail, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return mean, F.when(size > 1, F.sqrt(sq / (size - 1))).otherwise(0.0)


def recursive_forecast(
    hist: DataFrame,
    horizon: DataFrame,
    table: DataFrame,
    x: Sequence[str],
    spec: PanelSpec,
    steps: int = 12,
    direct: str | None = None,
    lag_steps: Sequence[int] = LAG_STEPS,
    windows: Sequence[int] = ROLL_WINDOWS,
) -> DataFrame:
    """(id, ts, entity, pred): the first ``steps`` rows of each entity's horizon feed every
    prediction back into the history features; later rows take the ``direct`` column (mid- or
    long-horizon prediction), or are left out without one.

    ``table`` is a ridge table by entity over ``x`` followed by ``history_features``. Only the
    last max(lag, window) targets and ``steps`` horizon rows of an entity are gathered.
    """
    e, keep = spec.entity, max([*lag_steps, *windows])
    past = (
        edge_rows(hist.filter(F.col(spec.target).isNotNull()), spec, keep, newest=True)
        .groupBy(e)
        .agg(F.array_sort(F.collect_list(F.struct(spec.ts, spec.id, spec.target))).alias("__h"))
        .select(e, F.transform("__h", lambda r: r[spec.target].cast("double")).alias("__hist"))
    )
    names = ["intercept", "coefs", "fills"]
    own = table.select(e, *[F.col(c).alias(f"__{c}") for c in names])
    first = edge_rows(horizon, spec, steps, newest=False)
    base = linear_score(x, F.col("__intercept"), F.col("__coefs"), F.col("__fills"))
    scored = join_table(first, own, [e], spec).withColumn("__base", base)
    packed = scored.groupBy(e).agg(
        F.array_sort(F.collect_list(F.struct(spec.ts, spec.id, "__base"))).alias("__rows"),
        F.first("__coefs").alias("__coefs"),
        F.first("__fills").alias("__fills"),
    )
    state = join_table(packed, past, [e], spec).withColumn(
        "__hist", F.coalesce("__hist", F.array().cast("array<double>"))
    )
    k = len(x)

    def step(acc: Column, row: Column) -> Column:
        h = acc["hist"]
        values = [F.when(F.size(h) >= lag, F.try_element_at(h, F.lit(-lag))) for lag in lag_steps]
        for n in windows:
            mean, std = _tail_stats(h, n)
            values += [F.when(F.size(h) > 0, mean), F.when(F.size(h) > 0, std)]
        pred = row["__base"]
        for i, v in enumerate(values):
            filled = clip(F.coalesce(v, F.col("__fills")[k + i]), -LIMIT, LIMIT)
            pred = pred + F.col("__coefs")[k + i] * filled
        grown = F.concat(h, F.array(pred))
        kept = F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), F.lit(keep))
        return F.struct(kept.alias("hist"), F.concat(acc["out"], F.array(pred)).alias("out"))

    start = F.struct(
        F.col("__hist").alias("hist"), F.array().cast("array<double>").alias("out")
    )
    run = state.withColumn(
        "__out", F.aggregate("__rows", start, step, lambda acc: acc["out"])
    )
    near = run.select(
        e, F.inline(F.arrays_zip(F.col("__rows").alias("r"), F.col("__out").alias("p")))
    ).select(
        F.col(f"r.{spec.id}").alias(spec.id), F.col(f"r.{spec.ts}").alias(spec.ts), e, F.col("p").alias("pred")
    )
    if direct is None:
        return near
    far = horizon.join(near.select(spec.id), spec.id, "left_anti")
    return near.unionByName(far.select(spec.id, spec.ts, e, F.col(direct).alias("pred")))


# --- feature groups and importance ---------------------------------------------------------


def correlation_groups(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """(group_id, feature, group_size, corr_threshold): connected parts of the graph of
    features with absolute correlation from the threshold up. The id depends on the members."""
    linked = np.nan_to_num(np.abs(pair_correlations(df, cols))) >= threshold
    label = list(range(len(cols)))
    changed = True
    while changed:  # features are few; labels spread to the smallest index of each part
        new = [min([label[i], *[label[j] for j in np.flatnonzero(linked[i])]]) for i in range(len(cols))]
        changed, label = new != label, new
    rows = []
    for root in sorted(set(label)):
        members = sorted(c for c, g in zip(cols, label) if g == root)
        group = "group_" + hashlib.md5("|".join(members).encode()).hexdigest()[:12]
        rows += [(group, m, len(members), float(threshold)) for m in members]
    return df.sparkSession.createDataFrame(
        rows, "group_id string, feature string, group_size int, corr_threshold double"
    )


def _partners(ids: DataFrame, spec: PanelSpec, seeds: Sequence[int], identity: bool = False) -> DataFrame:
    """(__g, id, __from): for seed number g, the row that each row takes its values from.

    The row at place p by id takes them from the row at place p by seeded hash. Only ids are
    ordered, by range, so the permutation is the same however many rows or tasks there are."""
    i = F.col(spec.id)
    ids = materialize(ids.select(i))
    n = ids.count()
    seed = F.get(F.array(*[F.lit(s).cast("long") for s in seeds]), F.col("__g"))
    drawn = i if identity else F.xxhash64(i, seed)
    every = ids.select(i, F.explode(F.lit(list(range(len(seeds))))).alias("__g"))
    source = positions(every, [F.col("__g"), drawn, i], "__pos").select(
        "__g", (F.col("__pos") - F.col("__g") * n).alias("__pos"), i.alias("__from")
    )
    return positions(ids, [i], "__pos").join(source, "__pos").drop("__pos")


def permute_columns(
    df: DataFrame, cols: Sequence[str], spec: PanelSpec, seed: int, identity: bool = False
) -> DataFrame:
    """Rows with the values of ``cols`` moved together by a seeded permutation of all rows."""
    pairs = _partners(df, spec, [seed], identity).drop("__g")
    source = df.select(F.col(spec.id).alias("__from"), *cols)
    moved = df.drop(*cols).join(pairs, spec.id).join(source, "__from")
    return moved.select(*df.columns)


#: Types whose values a double holds exactly; others are moved as text.
NUMBERS = ("double", "float", "int", "smallint", "tinyint")


def _moved(
    val: DataFrame, groups: Mapping[str, Sequence[str]], spec: PanelSpec, seed: int, fold: int
) -> tuple[DataFrame, int]:
    """Rows of ``val`` with ``__moved``: per group of columns their values in the row drawn for it, as
    numbers and texts in the group's order.

    Rows stand in the order of a seeded hash of their id; for group g a row draws the row s(g) places behind it,
    around the end. So one order serves all groups, and what is moved is each group's own columns."""
    pick = F.md5(F.concat(F.col(spec.id).cast("string"), F.lit(f":{seed}")))
    placed = positions(val.select(spec.id, pick.alias("__pick")), [F.col("__pick"), F.col(spec.id)], "__pos")
    rows = materialize(val.join(placed.drop("__pick"), spec.id))
    n, kind = rows.count(), dict(val.dtypes)
    draws = []
    for g, (name, cols) in enumerate(groups.items()):
        shift = 1 + zlib.crc32(f"{seed}/{fold}/{name}".encode()) % (n - 1) if n > 1 else 0
        numbers = [F.col(c).cast("double") if kind[c] in NUMBERS else F.lit(None).cast("double") for c in cols]
        texts = [F.lit(None).cast("string") if kind[c] in NUMBERS else F.col(c).cast("string") for c in cols]
        draws.append(
            F.struct(
                F.pmod(F.col("__pos") - shift, F.lit(max(n, 1))).alias("__to"), F.lit(g).alias("g"),
                F.array(*numbers).alias("numbers"), F.array(*texts).alias("texts"),
            )
        )
    sent = rows.select(F.inline(F.array(*draws)))
    drawn = sent.groupBy("__to").agg(F.collect_list(F.struct("g", "numbers", "texts")).alias("__moved"))
    return rows.join(drawn, F.col("__pos") == F.col("__to")).drop("__pos", "__to"), n


def permutation_importance(
    val: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    groups: Mapping[str, Sequence[str]],
    spec: PanelSpec,
    seed: int = 42,
    fold: int = 1,
    pred: str = "pred",
) -> DataFrame:
    """(fold, name, group_size, baseline_rmse, rmse_permuted, delta, n_val_rows) for features,
    groups or families of features.

    All groups are permuted and predicted in one job. A row first meets the values drawn for it, of which each
    group moves only its own columns; only then it is repeated, once per group and once unchanged, so the
    copies are never shuffled. ``predict`` must keep other columns. Ids are unique."""
    names = list(groups)
    both, _ = _moved(val, groups, spec, seed, fold)
    unchanged = F.struct(
        F.lit(-1).alias("g"), F.array().cast("array<double>").alias("numbers"), F.array().cast("array<string>").alias("texts")
    )
    rows = both.withColumn("__m", F.explode(F.concat(F.array(unchanged), "__moved"))).drop("__moved")
    kind, changed = dict(val.dtypes), {}
    for c in sorted({c for cols in groups.values() for c in cols}):
        places = F.array(*[F.lit(list(cols).index(c) if c in cols else None).cast("int") for cols in groups.values()])
        at = F.when(F.col("__m.g") >= 0, F.get(places, F.col("__m.g")))
        value = F.get(F.col("__m.numbers" if kind[c] in NUMBERS else "__m.texts"), at).cast(kind[c])
        changed[c] = F.when(at.isNotNull(), value).otherwise(F.col(f"`{c}`"))
    shuffled = rows.withColumns(changed).withColumn("__g", F.col("__m.g")).drop("__m")
    err = F.col(pred) - F.col(spec.target)
    scored = predict(shuffled).groupBy("__g").agg(rmse(err).alias("r"), F.count(err).alias("n"))
    return _importance(val, groups, {row["__g"]: (row["r"], row["n"]) for row in scored.collect()}, names, fold)


def ridge_importance(
    val: DataFrame,
    table: DataFrame,
    by: Sequence[str],
    x: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    spec: PanelSpec,
    seed: int = 42,
    fold: int = 1,
) -> DataFrame:
    """``permutation_importance`` of a ridge table without repeating rows: a row's error under each group is
    its own error plus the coefficients times the change of the group's features, one array per row."""
    names, at = list(groups), {c: i for i, c in enumerate(x)}
    both, _ = _moved(val, groups, spec, seed, fold)
    own = table.select(*by, *[F.col(n).alias(f"__{n}") for n in ("intercept", "coefs", "fills")])
    rows = _with(both, own, by, spec)
    base = linear_score(x, F.col("__intercept"), F.col("__coefs"), F.col("__fills")) - F.col(spec.target)
    rows = rows.withColumn("__err", base).withColumn("__now", F.array(*[_filled(c, F.col("__fills")[at[c]]) for c in x]))
    used = F.array(*[F.array(*[F.lit(at.get(c)).cast("int") for c in cols]) for cols in groups.values()])

    def error(moved: Column) -> Column:
        pairs = F.arrays_zip(F.get(used, moved["g"]).alias("i"), moved["numbers"].alias("v"))

        def change(total: Column, p: Column) -> Column:
            v, fill = p["v"], F.get(F.col("__fills"), p["i"])
            v = clip(F.coalesce(F.when(F.abs(v) < float("inf"), v), fill), -LIMIT, LIMIT)
            step = F.get(F.col("__coefs"), p["i"]) * (v - F.get(F.col("__now"), p["i"]))
            return total + F.when(p["i"].isNull(), F.lit(0.0)).otherwise(step)

        return F.struct(moved["g"].alias("g"), F.aggregate(pairs, F.col("__err"), change).alias("e"))

    errors = F.concat(F.array(F.struct(F.lit(-1).alias("g"), F.col("__err").alias("e"))), F.transform("__moved", error))
    scored = rows.select(F.inline(errors)).groupBy("g").agg(rmse("e").alias("r"), F.count("e").alias("n"))
    return _importance(val, groups, {row["g"]: (row["r"], row["n"]) for row in scored.collect()}, names, fold)


def _importance(val: DataFrame, groups: Mapping[str, Sequence[str]], result: Mapping, names: Sequence[str], fold: int) -> DataFrame:
    """One row per group; none without rows."""
    base = result.get(-1)
    table = [
        (fold, n, len(groups[n]), base[0], result[k][0], result[k][0] - base[0], base[1])
        for k, n in enumerate(names)
        if base and base[0] is not None
    ]
    return val.sparkSession.createDataFrame(
        table,
        "fold int, name string, group_size int, baseline_rmse double, rmse_permuted double, "
        "delta double, n_val_rows bigint",
    )


def importance_summary(perm: DataFrame, spec: PanelSpec, by: str = "name") -> DataFrame:
    """Over folds: mean, median and std of the error increase, folds where it is positive."""
    table = quantiles(perm, [by], {"median_delta": ("delta", 0.5)}, spec)
    base = perm.groupBy(by).agg(
        F.max("group_size").alias("group_size"),
        F.avg("delta").alias("mean_delta"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_delta"),
        F.count_if(F.col("delta") > 0).alias("positive_fold_count"),
        F.count("delta").alias("n_folds"),
    )
    return attach(base, table, [by])


# --- peers ---------------------------------------------------------------------------------


def peer_features(
    df: DataFrame,
    spec: PanelSpec,
    names: Sequence[str],
    history: DataFrame,
    pred: str = "global_pred",
    lookback: int = 168,
    min_periods: int = 24,
) -> DataFrame:
    """What the other entities' predictions at the same timestamp say.

    Columns per entity (own prediction where absent), mean / median / std of the others, spreads,
    and their mean weighted by the rolling target correlation before that timestamp (the last
    known one, else the overall one, else 0).
    """
    e, t = spec.entity, spec.ts
    wide = df.groupBy(t).agg(
        *[F.avg(F.when(F.col(e) == n, F.col(pred))).alias(f"__p{i}") for i, n in enumerate(names)]
    )
    out = attach(df, wide, [t])
    own = F.col(pred)
    peer = {n: F.coalesce(F.col(f"__p{i}"), own) for i, n in enumerate(names)}
    out = out.withColumns({f"pred_{n}": c for n, c in peer.items()})

    # One array of (weight, value) per row, without the row's own entity.
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    known = history.filter(F.col(spec.target).isNotNull())
    series = rolling_pair_corr(known, spec, pairs, max(lookback, 24), max(min_periods, 12))
    last = series.filter(F.col("corr").isNotNull()).groupBy("a", "b").agg(
        F.max_by("corr", t).alias("__last")
    )
    plain = known.groupBy(t).agg(
        *[F.avg(F.when(F.col(e) == n, F.col(spec.target))).alias(f"__t{i}") for i, n in enumerate(names)]
    ).agg(
        *[
            safe_corr(f"__t{names.index(a)}", f"__t{names.index(b)}").alias(f"__c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    last_wide = last.agg(
        *[
            F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("__last"))).alias(f"__l{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    at = series.groupBy(t).agg(
        *[
            F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("corr"))).alias(f"__r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    out = attach(out, at, [t])
    back, overall = row_scalars(last_wide), row_scalars(plain)
    weight = {
        p: F.coalesce(F.col(f"__r{i}"), back[f"__l{i}"], overall[f"__c{i}"], F.lit(0.0))
        for i, p in enumerate(pairs)
    }
    out = out.withColumns({f"__w{i}": weight[p] for i, p in enumerate(pairs)})
    number = {p: i for i, p in enumerate(pairs)}

    def others(name: str) -> Column:
        rows = []
        for n in names:
            if n != name:
                p = (name, n) if (name, n) in number else (n, name)
                rows.append(F.struct(F.col(f"__w{number[p]}").alias("w"), F.col(f"pred_{n}").alias("v")))
        return F.array(*rows)

    cases = F.lit(None)
    for n in reversed(names):
        cases = F.when(F.col(e) == n, others(n)).otherwise(cases)
    out = out.withColumn("__o", cases)
    vals = F.array_sort(F.transform("__o", lambda x: x.v))
    size = F.size(vals)

    def total(array: Column, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))

    out = out.withColumns({"__v": vals, "__n": size})
    mean = total(F.col("__v"), lambda v: v) / F.col("__n")
    out = out.withColumn("peer_mean", F.when(F.col("__n") > 0, mean).otherwise(own))
    half = F.col("__n") / 2
    low = F.element_at("__v", F.ceil(half).cast("int"))
    high = F.element_at("__v", (F.floor(half) + 1).cast("int"))
    sq = total(F.col("__v"), lambda v: (v - F.col("peer_mean")) * (v - F.col("peer_mean")))
    den = total(F.col("__o"), lambda x: F.abs(x.w))
    signal = total(F.col("__o"), lambda x: x.w * x.v)
    out = out.withColumns(
        {
            "peer_median": F.when(F.col("__n") > 0, (low + high) / 2).otherwise(own),
            "peer_std": F.when(F.col("__n") > 1, F.sqrt(sq / (F.col("__n") - 1))).otherwise(0.0),
            **{f"spread_vs_{n}": own - F.col(f"pred_{n}") for n in names},
            "peer_corr_signal": F.when(den > 1e-6, signal / den).otherwise(F.col("peer_mean")),
            "peer_corr_strength": den / max(len(names) - 1, 1),
        }
    )
    extra = [c for c in out.columns if c.startswith("__")]
    return out.drop(*extra)


# --- specialists ---------------------------------------------------------------------------


def proxy_feature(
    df: DataFrame, x: Sequence[str], spec: PanelSpec, min_rows: int = 100, family: str = "gbt", **params
) -> DataFrame:
    """Wind production estimated from weather, and what follows from it; NULL with fewer than
    ``min_rows`` rows to fit on."""
    known = df.filter(F.col("wind_forecast").isNotNull())
    if known.limit(min_rows).count() < min_rows:
        out = df.withColumn("wind_prod_est", F.lit(None).cast("double"))
    else:
        out = fit_global(known, x, "wind_forecast", family, spec, **params).predict(df, "wind_prod_est")
    est, load = F.col("wind_prod_est"), F.col("load_forecast")
    rest = load - F.col("solar_forecast") - est
    return out.withColumns(
        {
            "residual_load_est": rest,
            "wind_prod_est_ratio": F.try_divide(est, load + 1e-6),
            "residual_load_est_share": F.try_divide(rest, load + 1e-6),
            "wind_forecast_proxy_gap": F.col("wind_forecast") - est,
        }
    )


def hour_experts(
    df: DataFrame,
    x: Sequence[str],
    spec: PanelSpec,
    base: str,
    min_rows: int,
    alpha: float = 25.0,
    regime: str = "hour_regime",
) -> DataFrame:
    """Ridge of the residual of ``base`` per (entity, hour regime) with enough rows."""
    rows = df.withColumn("__rest", F.col(spec.target) - F.col(base))
    return grouped_ridge(rows, [spec.entity, regime], x, "__rest", spec, alpha, min_rows)


def apply_hour_experts(
    df: DataFrame,
    table: DataFrame,
    x: Sequence[str],
    spec: PanelSpec,
    base: str,
    min_rows: int,
    weight: float,
    out: str = "pred",
    regime: str = "hour_regime",
) -> DataFrame:
    """base + weight * n / (n + min_rows) * expert residual; base alone without an expert."""
    keys = [spec.entity, regime]
    scored = predict_ridge(df, table, keys, x, spec, "__adj")
    scored = attach(scored, table.select(*keys, F.col("n").alias("__n")), keys)
    rows = F.coalesce("__n", F.lit(0))
    share = rows / (rows + F.lit(float(max(min_rows, 1))))
    return scored.withColumn(
        out, F.col(base) + weight * share * F.coalesce("__adj", F.lit(0.0))
    ).drop("__adj", "__n")
