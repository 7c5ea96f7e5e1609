"""Tree ensembles as flat arrays: walking them over numpy blocks, taking them from ``pyspark.ml``
models, and growing one ensemble per group with all groups in the same jobs.

Growth is level by level. A task keeps, per group and open node, the sums of each feature's bins
for the rows it reads, whatever their number; Spark adds them up by group, node and bin, and the best
split of every node comes from those sums. So the number of jobs is trees times depth however many
groups there are, and a group may lie in any number of tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.plans.layout import PanelSpec, attach
from panelkit.plans.ranks import finite, quantiles
from panelkit.sources.io import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes and bin edges of all groups together that a driver and a worker may hold.
HELD = 4_000_000
#: Partial sums a task holds before it passes them on.
HELD_SUMS = 2_000_000


@dataclass(frozen=True)
class Trees:
    """Trees one behind another. A row goes left where its feature is at most the threshold; a
    negative feature marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    scale: np.ndarray
    base: float = 0.0

    def walk(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root, scale in zip(self.roots, self.scale):
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            total += scale * self.value[at]
        return total


# --- models of pyspark.ml ------------------------------------------------------------------


def flatten(model) -> Trees:
    """The trees of a fitted forest or boosted model of ``pyspark.ml``. The driver holds the model
    already; what is read is as large as it."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def place(node) -> int:
        at = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        value[at] = node.prediction()
        if node.getClass().getSimpleName() == "LeafNode":
            feature[at] = -1
            return at
        split = node.split()
        feature[at] = split.featureIndex()
        low, high = node.leftChild(), node.rightChild()
        if split.getClass().getSimpleName() == "ContinuousSplit":
            threshold[at] = split.threshold()
        else:  # a category of two values, 0 and 1
            threshold[at] = 0.5
            if list(split.leftCategories()) == [1.0]:
                low, high = high, low
        left[at] = place(low)
        right[at] = place(high)
        return at

    trees = model.trees
    for tree in trees:
        roots.append(place(tree._call_java("rootNode")))
    boosted = type(model).__name__.startswith("GBT")
    scale = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    return Trees(
        np.array(feature, "i4"), np.array(threshold, float), np.array(left, "i4"), np.array(right, "i4"),
        np.array(value, float), np.array(roots, "i4"), np.array(scale, float),
    )


# --- one ensemble per group ----------------------------------------------------------------


@dataclass(frozen=True)
class GroupTrees:
    """An ensemble per group on the features ``x``; ``fills`` replace missing values."""

    x: list[str]
    models: dict
    fills: dict

    def score(self, group, block: np.ndarray) -> np.ndarray:
        """Predictions for rows of one group; NaN for a group without a model."""
        model = self.models.get(group)
        if model is None:
            return np.full(len(block), np.nan)
        block = np.where(np.isfinite(block), block, self.fills[group])
        return model.walk(block)

    def column(self, spark, entity: Column) -> Column:
        """The prediction as a column; NULL for a group without a model. The models go to the workers, HELD bounds them."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(group: pd.Series, *columns: pd.Series) -> pd.Series:
            models = shared.value
            block = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            out = np.full(len(group), np.nan)
            for name, at in _places(group).items():
                out[at] = models.score(name, block[at])
            return pd.Series(out).where(~np.isnan(out), None).astype("float64")

        score = scored(entity, *[F.col(c).cast("double") for c in self.x])
        return F.when(~F.isnan(score), score)


def _places(group: pd.Series) -> dict:
    places = {k: at for k, at in group.groupby(group, sort=False).indices.items()}
    missing = np.flatnonzero(group.isna().to_numpy())
    return places | ({None: missing} if len(missing) else {})


def _edges(df: DataFrame, by: str, x: Sequence[str], bins: int, spec: PanelSpec) -> DataFrame:
    """(by, edges: per feature the inner quantiles, fills: per feature the median)."""
    steps = [j / bins for j in range(1, bins)]
    if spec.bounded([by]):
        cuts = [F.percentile(finite(F.col(c).cast("double")), F.array(*map(F.lit, steps))).alias(f"__e{i}") for i, c in enumerate(x)]
        mids = [F.percentile(finite(F.col(c).cast("double")), F.lit(0.5)).alias(f"__m{i}") for i, c in enumerate(x)]
        table = df.groupBy(by).agg(*cuts, *mids)
    else:
        wanted = {f"__e{i}_{j}": (F.col(c).cast("double"), q) for i, c in enumerate(x) for j, q in enumerate(steps)}
        wanted |= {f"__m{i}": (F.col(c).cast("double"), 0.5) for i, c in enumerate(x)}
        table = quantiles(df, [by], wanted, spec)
        parts = {f"__e{i}": F.array(*[f"__e{i}_{j}" for j in range(len(steps))]) for i in range(len(x))}
        table = table.withColumns(parts)
    none = F.array().cast("array<double>")
    distinct = [F.array_distinct(F.coalesce(F.filter(f"__e{i}", lambda v: v.isNotNull()), none)) for i in range(len(x))]
    return table.select(
        by, F.array(*distinct).alias("edges"), F.array(*[F.coalesce(f"__m{i}", F.lit(0.0)) for i in range(len(x))]).alias("fills")
    )


def _best_split(n: np.ndarray, s: np.ndarray, min_rows: float) -> tuple[int, int, float, float] | None:
    """(feature, bin, left value, right value) of the largest gain, first feature and bin on ties.

    ``n`` and ``s`` hold the weights and the sums of what is to be predicted, by feature and bin."""
    left_n, left_s = n.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
    all_n, all_s = n[0].sum(), s[0].sum()
    right_n, right_s = all_n - left_n, all_s - left_s
    able = (left_n >= min_rows) & (right_n >= min_rows)
    if not able.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n, -np.inf)
    best = gain.max()
    scale = max(abs(all_s**2 / all_n), np.abs(s).sum() ** 2 / all_n, 1e-300)
    if best <= 1e-12 * scale:
        return None
    f, b = divmod(int(np.flatnonzero((gain >= best - 1e-9 * abs(best)).ravel())[0]), gain.shape[1])
    return f, b, float(left_s[f, b] / left_n[f, b]), float(right_s[f, b] / right_n[f, b])


class _Growing:
    """The trees of one group while they grow; thresholds are bins."""

    def __init__(self, base: float):
        self.base = base
        self.feature: list[int] = []
        self.bin: list[int] = []
        self.child: list[int] = []  # the left one; the right one follows
        self.value: list[float] = []
        self.roots: list[int] = []
        self.open: list[int] = []

    def start(self) -> None:
        self.roots.append(self.leaf(0.0))
        self.open = [self.roots[-1]]

    def leaf(self, value: float) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.child, 0), (self.value, value)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, f: int, b: int, low: float, high: float) -> None:
        self.feature[node], self.bin[node] = f, b
        self.child[node] = self.leaf(low)
        self.leaf(high)

    def packed(self, edges: Sequence[Sequence[float]] | None, scale: Sequence[float]) -> Trees:
        f = np.array(self.feature, "i4")
        t = np.array(self.bin, float)
        if edges is not None:
            t = np.array([edges[a][int(b)] if a >= 0 else 0.0 for a, b in zip(f, t)])
        c = np.array(self.child, "i4")
        return Trees(f, t, c, c + 1, np.array(self.value), np.array(self.roots, "i4"), np.array(scale, float), self.base)


def _poisson(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of rows by a hash of id, tree and seed, the same in every task."""
    with np.errstate(over="ignore"):
        h = ids.astype("u8") + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed * 0xC2B2AE3D27D4EB4F % 2**64)
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    u = (h >> np.uint64(11)).astype(float) / 2**53
    cut = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    return np.searchsorted(cut, u, side="right").astype(float)


def _tried(k: int, tree: int, node: int, seed: int) -> np.ndarray:
    """The features a node of a forest may split on: a third of them (at least one), by seed."""
    rng = np.random.default_rng([seed, tree, node])
    return np.sort(rng.permutation(k)[: max(1, -(-k // 3))])


def grow(
    df: DataFrame,
    by: str,
    x: Sequence[str],
    y: str,
    spec: PanelSpec,
    family: str = "gbt",
    trees: int = 20,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 32,
    min_rows: int = 1,
    seed: int = 42,
) -> GroupTrees:
    """A boosted model (``gbt``) or a random forest (``forest``) per group.

    Features are cut at exact quantiles of the group; missing, NaN and infinite ones take its median (0
    where it has none). Boosting starts at the mean and adds ``rate`` times each tree of residuals; a forest averages
    trees of rows drawn by Poisson weights over a third of the features a node. A node splits at the largest
    gain with ``min_rows`` on both sides. Rows without ``y`` are left out, a group without rows has no model."""
    if family not in ("gbt", "forest"):
        raise ValueError(f"unknown family {family}")
    x, k, boosted = list(x), len(x), family == "gbt"
    target = finite(F.col(y).cast("double"))
    rows = df.filter(target.isNotNull())
    means = rows.groupBy(by).agg(F.avg(target).alias("base"))
    table = attach(_edges(rows, by, x, bins, spec), means, [by])
    known = materialize(table)
    groups = known.count()
    if groups * (trees * 2 ** (depth + 1) + k * bins) > HELD:
        raise ValueError(f"{groups} groups with {trees} trees of depth {depth} are over the bound of {HELD} nodes; fit fewer at a time")
    held = {r[by]: (r["base"], r["edges"], r["fills"]) for r in known.collect()}

    # Rows are binned once: the number of edges below the value.
    place = [
        F.size(F.filter(F.col("edges")[i], lambda e: e < F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.col("fills")[i])))
        .cast("tinyint" if bins <= 127 else "int").alias(f"__b{i}")
        for i, c in enumerate(x)
    ]
    bounded = spec.table_rows() if by == spec.entity else None
    binned = materialize(
        attach(rows, known.select(by, "edges", "fills"), [by], bounded).select(
            F.col(by).alias("__g"), target.alias("__y"), F.col(spec.id).cast("long").alias("__id"), *place
        )
    )
    kinds = f"__g {dict(df.dtypes)[by]}, __node int, __p int, __v double"
    names = [f"__b{i}" for i in range(k)]
    growing = {g: _Growing(base if boosted else 0.0) for g, (base, *_) in held.items()}
    spark = df.sparkSession
    for tree in range(trees):
        for model in growing.values():
            model.start()
        for _level in range(depth):
            if not any(m.open for m in growing.values()):
                break
            scale = [rate if boosted else 0.0] * tree
            shared = spark.sparkContext.broadcast({g: (m.packed(None, [*scale, 0.0]), list(m.open)) for g, m in growing.items() if m.open})

            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                open_now, total = shared.value, {}

                def flush():
                    for (g, node), part in total.items():
                        flat = part.ravel()
                        at = np.flatnonzero(flat)
                        yield pd.DataFrame({"__g": pd.Series([g] * len(at), dtype=object), "__node": np.int32(node), "__p": at.astype("i4"), "__v": flat[at]})
                    total.clear()

                for batch in batches:
                    block = batch[names].to_numpy(dtype=float)
                    target_, ids = batch["__y"].to_numpy(dtype=float), batch["__id"].to_numpy(dtype="i8")
                    for g, at in _places(batch["__g"]).items():
                        if g not in open_now:
                            continue
                        model, nodes = open_now[g]
                        part = block[at]
                        rest = target_[at] - model.walk(part) if boosted else target_[at]
                        weight = np.ones(len(at)) if boosted else _poisson(ids[at], tree, seed)
                        leaf = _leaf(model, part)
                        for node in nodes:
                            here = np.flatnonzero(leaf == node)
                            cell = (np.arange(k) * bins + part[here].astype(int)).ravel()
                            w = np.repeat(weight[here], k)
                            both = np.stack([
                                np.bincount(cell, w, k * bins), np.bincount(cell, w * np.repeat(rest[here], k), k * bins)
                            ])
                            total[g, node] = total.get((g, node), 0.0) + both
                    if len(total) * 2 * k * bins > HELD_SUMS:
                        yield from flush()
                yield from flush()

            added = binned.mapInPandas(sums, kinds).groupBy("__g", "__node", "__p").agg(F.sum("__v").alias("__v"))
            packed = added.groupBy("__g", "__node").agg(F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("__s"))
            split_rows = packed.mapInPandas(
                _splits(k, bins, min_rows, None if boosted else (tree, seed)),
                f"__g {dict(df.dtypes)[by]}, __node int, f int, b int, low double, high double, value double",
            ).collect()  # a row per group and open node, bounded above
            for model in growing.values():
                model.open = []
            for r in split_rows:
                model = growing[r["__g"]]
                if r["__node"] == model.roots[-1]:
                    model.value[r["__node"]] = r["value"]
                if r["f"] is not None and r["f"] >= 0:
                    model.split(r["__node"], r["f"], r["b"], r["low"], r["high"])
                    model.open += [model.child[r["__node"]], model.child[r["__node"]] + 1]
            shared.unpersist()
    final = [rate] * trees if boosted else [1.0 / trees] * trees
    return GroupTrees(
        x,
        {g: m.packed(held[g][1], final) for g, m in growing.items()},
        {g: np.array(fills, float) for g, (_, _, fills) in held.items()},
    )


def _leaf(model: Trees, block: np.ndarray) -> np.ndarray:
    """The node of the last tree that each row has come to."""
    at, rows = np.full(len(block), model.roots[-1]), np.arange(len(block))
    while True:
        f = model.feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        left = block[rows, np.where(inner, f, 0)] <= model.threshold[at]
        at = np.where(inner, np.where(left, model.left[at], model.right[at]), at)


def _splits(k: int, bins: int, min_rows: int, forest: tuple[int, int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, node, sums in zip(batch["__g"], batch["__node"], batch["__s"]):
                flat = np.zeros(2 * k * bins)
                cells = dict(sums)
                flat[list(cells)] = list(cells.values())
                n, s = flat.reshape(2, k, bins)
                tried = np.arange(k) if forest is None else _tried(k, forest[0], int(node), forest[1])
                best = _best_split(n[tried], s[tried], min_rows)
                value = float(s[0].sum() / n[0].sum()) if n[0].sum() else 0.0
                out.append((g, node, *((int(tried[best[0]]), *best[1:]) if best else (-1, -1, 0.0, 0.0)), value))
            yield pd.DataFrame(out, columns=["__g", "__node", "f", "b", "low", "high", "value"]).astype({"__g": object})

    return run

