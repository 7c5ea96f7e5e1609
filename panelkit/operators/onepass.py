"""Walk-forward ridge fits of all folds from one pass over the rows.

Rows are cut into stretches between the ends of the folds' training parts. One aggregate gives the sums of
products of each stretch and profile cell; a fold's training part is the sum of the stretches before its
end. What differs between folds enters behind the sums: the value that replaces missing features (the
columns hold 0 there, beside a column that marks it), and the profiles of the target, which are
constant in a cell. So the number of jobs and of scans does not depend on the number of folds."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import clip, flag, wall_clock
from panelkit.operators.model import _finite, fold_bounds, predict_ridge
from panelkit.operators.profile import summarize, table_bound
from panelkit.plans.gram import LIMIT, gram, ridge_solution, square
from panelkit.plans.layout import PanelSpec, attach
from panelkit.sources.io import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that occur ``counts`` times, halfway between the middle two."""
    order = np.argsort(values, kind="stable")
    values, ends = values[order], np.cumsum(counts[order])
    n = int(ends[-1])
    low, high = (int(np.searchsorted(ends, place, side="right")) for place in ((n - 1) // 2, n // 2))
    return float((values[low] + values[high]) / 2.0)


def _solved(cells: pd.DataFrame, fills: np.ndarray, centre: np.ndarray, profiles: list[list[int]], k: int, alpha: float):
    """(n, mean of y, intercept, coefs, fills) of one group and fold.

    ``cells``: a triangle of sums of [1, z, missing, y] per cell, ``key`` the cell's values; z and y are taken
    around ``centre`` (y last)."""
    size = 2 * k + 2
    g = np.array([square(t, size) for t in cells["gram"]])
    total = g.sum(0)
    n = total[0, 0]
    shift = np.clip(fills, -LIMIT, LIMIT) - centre[:k]
    # Filled features are z plus the marks of missing ones times the fill.
    t = np.zeros((k + 2, size))
    t[0, 0] = t[k + 1, size - 1] = 1.0
    t[np.arange(1, k + 1), np.arange(1, k + 1)] = 1.0
    t[np.arange(1, k + 1), np.arange(k + 1, 2 * k + 1)] = shift
    first = g[:, 0, :] @ t.T  # per cell: rows, sums of features, sum of y
    counts, sums = g[:, 0, 0], g[:, 0, -1]
    means = []
    for places in profiles:
        key = [tuple(c[p] for p in places) for c in cells["key"]]
        code = pd.factorize(pd.Series(key, dtype=object))[0]
        by_n, by_s = np.bincount(code, counts), np.bincount(code, sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            means.append((by_s / by_n)[code])
    p = np.array(means).reshape(len(profiles), len(cells))
    p = np.where(counts > 0, p, 0.0)
    inner = t @ total @ t.T
    full = np.zeros((k + len(profiles) + 2,) * 2)
    old = [*range(k + 1), -1]
    new = [*range(k + 1, k + 1 + len(profiles))]
    full[np.ix_(old, old)] = inner
    cross = p @ first  # profiles x [1, features, y]
    full[np.ix_(new, old)] = cross
    full[np.ix_(old, new)] = cross.T
    full[np.ix_(new, new)] = (p * counts) @ p.T
    centres = np.concatenate([centre[:k], np.full(len(profiles), centre[k])])
    tri = full[np.triu_indices(len(full))]
    intercept, coefs = ridge_solution(tri, centres, centre[k], k + len(profiles), alpha)
    mean = centre[k] + full[0, -1] / n
    if not np.any(coefs):
        intercept = mean
    middle = [weighted_median(row[counts > 0], counts[counts > 0]) + centre[k] for row in p]
    return int(n), float(mean), float(intercept), coefs, np.concatenate([fills, middle])


def fold_ridge(
    df: DataFrame,
    folds: DataFrame,
    spec: PanelSpec,
    x: Sequence[str],
    by: Sequence[str],
    profiles: Mapping[str, Sequence[str]] | None = None,
    alpha: float = 25.0,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ridge per group and fold on ``x`` and the mean targets named by ``profiles`` (name -> keys, the group's
    among them), and the profile tables (keys, fold, name).

    The same models as ``grouped_ridge`` and ``profile`` give on each fold's training rows alone."""
    by, x, y = list(by), list(x), spec.target
    profiles = {name: list(keys) for name, keys in (profiles or {}).items()}
    cell = list(dict.fromkeys([*by, *[c for keys in profiles.values() for c in keys]]))
    bounds = fold_bounds(folds)
    ends = sorted({f["train_end"] for f in bounds})
    if not ends:
        raise ValueError("no folds")
    place = {f["fold"]: ends.index(f["train_end"]) for f in bounds}
    stretch = reduce(lambda a, b: a + b, [flag(F.col(spec.ts) >= wall_clock(e)) for e in ends])
    rows = df.filter(F.col(y).isNotNull() & (F.col(spec.ts) < wall_clock(ends[-1])))
    rows = rows.select(*cell, y, *[c for c in x if c not in cell], stretch.cast("int").alias("__s"))

    # Medians of every fold in one aggregate: a row counts for all folds that end after its stretch.
    k = len(x)
    in_folds = rows.withColumn("__f", F.explode(F.sequence(F.col("__s"), F.lit(len(ends) - 1))))
    medians = {f"__m{i}": (_finite(c), 0.5) for i, c in enumerate(x)}
    fills = F.array(*[F.coalesce(m, F.lit(0.0)) for m in medians]).cast("array<double>").alias("fills")
    known = materialize(summarize(in_folds, [*by, "__f"], {"mean_y": F.avg(y)}, medians, spec).select(*by, "__f", "mean_y", fills))
    last = known.filter(F.col("__f") == len(ends) - 1)
    centre = F.concat(F.transform("fills", lambda v: clip(v, -LIMIT, LIMIT)), F.array("mean_y"))
    centred = attach(rows, last.select(*by, centre.alias("__c")), by, table_bound(spec, by), "inner")
    z = [F.coalesce(clip(_finite(c), -LIMIT, LIMIT) - F.col("__c")[i], F.lit(0.0)) for i, c in enumerate(x)]
    missing = [flag(_finite(c).isNull()).cast("double") for c in x]
    cells = materialize(gram(centred, [*cell, "__s"], [*z, *missing, F.col(y) - F.col("__c")[k]]))

    places = [[cell.index(c) for c in keys] for keys in profiles.values()]
    packed_cells = cells.select(*by, F.struct(F.array(*[F.col(c).cast("string") for c in cell]).alias("key"), "__s", "gram").alias("__cell"))
    per_group = packed_cells.groupBy(*by).agg(F.collect_list("__cell").alias("__cells"))  # as many as cells and stretches
    fold_fills = known.groupBy(*by).agg(F.collect_list(F.struct("__f", "fills", "mean_y")).alias("__known"))
    group = attach(per_group, fold_fills, by)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in group.select(*by).schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                held = pd.DataFrame([(tuple(c["key"]), c["__s"], c["gram"]) for c in row["__cells"]], columns=["key", "s", "gram"])
                own = {r["__f"]: (np.array(r["fills"], float).reshape(k), r["mean_y"]) for r in row["__known"]}
                mid = np.append(np.clip(own[len(ends) - 1][0], -LIMIT, LIMIT), own[len(ends) - 1][1])
                for fold, j in place.items():
                    if j in own:
                        part = held[held["s"] <= j]
                        out.append((*[row[b] for b in by], fold, *_solved(part, own[j][0], mid, places, k, alpha)))
            made = pd.DataFrame(out, columns=[*by, "fold", "n", "mean_y", "intercept", "coefs", "fills"])
            yield made.astype({b: object for b in by})

    models = group.mapInPandas(
        solve, keys + "fold int, n bigint, mean_y double, intercept double, coefs array<double>, fills array<double>"
    )

    # Profiles: the cells' sums of y added up over the stretches before each fold's end.
    ending = F.explode(F.array(*[F.struct(F.lit(f).cast("int").alias("fold"), F.lit(j).alias("j")) for f, j in place.items()]))
    sums = attach(
        cells.select(*cell, "__s", F.col("gram")[0].alias("__n"), F.col("gram")[2 * k + 1].alias("__y")),
        last.select(*by, F.col("mean_y").alias("__mid")), by, table_bound(spec, by),
    )
    spread = sums.withColumn("__e", ending).filter(F.col("__s") <= F.col("__e.j"))
    tables = {
        name: spread.groupBy(*own, F.col("__e.fold").alias("fold")).agg(
            (F.max("__mid") + F.sum("__y") / F.sum("__n")).alias(name)
        )
        for name, own in profiles.items()
    }
    return materialize(models), tables


def walk_forward_ridge(
    df: DataFrame,
    folds: DataFrame,
    spec: PanelSpec,
    x: Sequence[str],
    profiles: Mapping[str, Sequence[str]] | None = None,
    by: Sequence[str] | None = None,
    alpha: float = 25.0,
) -> DataFrame:
    """Out-of-fold table (id, ts, entity, target, pred, fold) of a ridge per group refitted before each fold,
    as ``walk_forward`` gives it, in a number of jobs that does not grow with the folds. A row in several
    folds' validation parts comes once for each; a group without training rows predicts NULL."""
    by, profiles = list(by or [spec.entity]), profiles or {}
    models, tables = fold_ridge(df, folds, spec, x, by, profiles, alpha)
    t = F.col(spec.ts)
    hits = []
    for f in fold_bounds(folds):
        inside = t >= wall_clock(f["val_start"])
        if f["val_end"] is not None:
            inside = inside & (t < wall_clock(f["val_end"]))
        hits.append(F.when(inside, F.lit(f["fold"]).cast("int")))
    rows = df.withColumn("fold", F.explode(F.array_compact(F.array(*hits))))
    for name, keys in profiles.items():
        cells = table_bound(spec, keys)
        rows = attach(rows, tables[name], [*keys, "fold"], cells * len(hits) if cells else None)
    scored = predict_ridge(rows, models, [*by, "fold"], [*x, *profiles], spec)
    return scored.select(spec.id, spec.ts, spec.entity, spec.target, "pred", "fold")
