"""Sums of products of columns, per group: the sufficient statistics of linear fits."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions of this module run inside tasks; send their code along, so that executors need
# numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Features are held within +-LIMIT in linear fits.
LIMIT = 1e7
# Up to this many columns all products are ordinary sums in one aggregate; longer lists of sums
# compile badly and take longer than matrix products.
NARROW = 9
# Partial sums a task holds before it passes them on.
HELD_VALUES = 4_000_000


def upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram(df: DataFrame, by: Sequence[str], cols: Sequence[Column | str]) -> DataFrame:
    """(by, gram): the upper triangle of A'A, row by row, of A = [1, cols] without NULLs.

    Few columns use built-in sums. Many columns use matrix products on Arrow batches; each task
    sends one partial triangle per group, which Spark then adds up.
    """
    by = list(by)
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    k = len(cols) + 1
    if k <= NARROW + 1:
        a = [F.lit(1.0), *[c.cast("double") for c in cols]]
        sums = [F.sum(a[i] * a[j]) for i, j in upper(k)]
        return df.groupBy(*by).agg(F.array(*sums).alias("gram"))

    names = [f"__x{i}" for i in range(len(cols))]
    flat = df.select(*by, *[c.cast("double").alias(n) for c, n in zip(cols, names)])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in flat.select(*by).schema)
    size = k * (k + 1) // 2
    limit = max(HELD_VALUES // size, 1)
    rows, columns = np.triu_indices(k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=by)
            out["gram"] = list(held.values())
            held.clear()
            return out

        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, part in groups:
                x = part[names].to_numpy(dtype=float)
                a = np.hstack([np.ones((len(x), 1)), x])
                tri = (a.T @ a)[rows, columns]
                held[key] = held[key] + tri if key in held else tri
            if len(held) >= limit:
                yield flush()
        if held:
            yield flush()

    partials = flat.mapInPandas(partial, schema + "gram array<double>")
    added = (
        partials.select(*by, F.posexplode("gram").alias("__p", "__v"))
        .groupBy(*by, "__p")
        .agg(F.sum("__v").alias("__v"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("__p", "__v")))
    return added.groupBy(*by).agg(F.transform(ordered, lambda x: x["__v"]).alias("gram"))


def square(tri: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    rows, columns = np.triu_indices(k)
    out[rows, columns] = tri
    return out + np.triu(out, 1).T


def ridge_solution(
    tri: Sequence[float], fills: Sequence[float], mean_y: float, k: int, alpha: float
) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) from the shifted sums of one group."""
    g = square(tri, k + 2)
    n = g[0, 0]
    m, my = g[0, 1 : k + 1] / n, g[0, k + 1] / n
    cov = g[1 : k + 1, 1 : k + 1] / n - np.outer(m, m)
    cross = g[1 : k + 1, k + 1] / n - m * my
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    std = np.where(std > 1e-12, std, 1.0)
    try:
        w = np.linalg.solve(n * cov / np.outer(std, std) + alpha * np.eye(k), n * cross / std)
    except np.linalg.LinAlgError:
        w = np.full(k, np.nan)
    if not np.all(np.isfinite(w)):
        return float(mean_y), np.zeros(k)
    coefs = w / std
    shift = np.clip(np.asarray(fills, dtype=float), -LIMIT, LIMIT)
    return float(mean_y + my - coefs @ (shift + m)), coefs


def pair_sums(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, sums): pairwise-complete sums of ``cols`` per group as four k x k matrices, row by row: the rows
    where both are present, and the sums of x, of x x and of x y over them. NaN counts as missing.

    Values are taken around the columns' means. One pass of matrix products over Arrow batches; a task keeps
    four matrices per group whatever the number of rows it reads, and sends as many sums."""
    by, k = list(by), len(cols)
    quoted = [F.col(f"`{c}`").cast("double") for c in cols]
    centre = df.agg(*[F.avg(F.when(~F.isnan(c), c)).alias(f"__{i}") for i, c in enumerate(quoted)]).first()
    names = [f"__x{i}" for i in range(k)]
    shifted = [(c - F.lit(float(centre[i] or 0.0))).alias(n) for i, (c, n) in enumerate(zip(quoted, names))]
    flat = df.select(*by, *shifted)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in flat.select(*by).schema)
    limit = max(HELD_VALUES // (4 * k * k), 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {} if by else {(): np.zeros(4 * k * k)}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([dict(zip(by, key)) for key in held], columns=by, index=range(len(held))).astype(object)
            out["sums"] = list(held.values())
            held.clear()
            return out

        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, part in groups:
                x = part[names].to_numpy(dtype=float, na_value=np.nan)
                m = (~np.isnan(x)).astype(float)
                x = np.where(m > 0, x, 0.0)
                made = np.concatenate([(m.T @ m).ravel(), (x.T @ m).ravel(), ((x * x).T @ m).ravel(), (x.T @ x).ravel()])
                held[key] = held[key] + made if key in held else made
            if len(held) >= limit:
                yield flush()
        if held:
            yield flush()

    added = (
        flat.mapInPandas(partial, keys + "sums array<double>")
        .select(*by, F.posexplode("sums").alias("__p", "__v"))
        .groupBy(*by, "__p")
        .agg(F.sum("__v").alias("__v"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("__p", "__v")))
    return added.groupBy(*by).agg(F.transform(ordered, lambda x: x["__v"]).alias("sums"))


def correlations(sums: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, correlation) of every pair from ``pair_sums``; NaN where a side is constant."""
    n, sx, sxx, sxy = np.asarray(sums, float).reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = sx / n, sx.T / n
        vx, vy = sxx / n - mx**2, sxx.T / n - my**2
        tiny = 1e-12
        moving = (vx > tiny * (sxx / n)) & (vy > tiny * (sxx.T / n))
        return n, (sxy / n - mx * my) / np.sqrt(np.where(moving, vx * vy, np.nan))


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pairwise-complete Pearson matrix; NaN where a side is constant. Only k x k sums reach the driver."""
    k = len(cols)
    row = pair_sums(df, [], cols).first()
    if row is None or not row["sums"]:
        return np.full((k, k), np.nan)
    return np.clip(correlations(row["sums"], k)[1], -1.0, 1.0)


def pair_table(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], wanted: Sequence[tuple[str, str, int, int]], min_rows: int = 0
) -> DataFrame:
    """(by, a, b, n, corr) for ``wanted`` (a, b, place of x, place of y in ``cols``), all pairs and groups from
    one pass. NULL where a side is constant or fewer than ``min_rows`` rows have both."""
    by, k = list(by), len(cols)
    sums = pair_sums(df, by, cols)
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.select(*by).schema)
    a, b = [w[0] for w in wanted], [w[1] for w in wanted]
    x, y = np.array([w[2] for w in wanted]), np.array([w[3] for w in wanted])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n, r = correlations(row["sums"], k)
                size, corr = n[x, y], r[x, y]
                corr = np.where((size >= min_rows) & ~np.isnan(corr), corr, np.nan)
                out = pd.DataFrame({"a": a, "b": b, "n": size.astype("int64")}).astype({"a": object, "b": object})
                out["corr"] = pd.Series([None if np.isnan(v) else float(v) for v in corr], dtype=object)
                for i, name in enumerate(by):
                    out.insert(i, name, pd.Series([row[name]] * len(out), dtype=object))
                yield out

    return sums.mapInPandas(pairs, keys + "a string, b string, n bigint, corr double")
