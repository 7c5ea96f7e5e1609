"""Correlation analytics between entities, features and prediction runs.

Entities or runs are named by the caller. Each timestamp becomes one row with a column per name. Few
pairs are then built-in sums of one aggregate; more are matrix products on Arrow batches that a task
adds up per group, so any number of pairs takes one pass and no pair rows are shuffled."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import as_list, null_if_nan, safe_corr
from panelkit.plans.gram import pair_sums, pair_table
from panelkit.plans.layout import GroupBound, PanelSpec
from panelkit.plans.ranks import first_rows, positions, rank_pct
from panelkit.sources.io import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Up to this many pairs all sums are built-in ones in one aggregate.
FEW_PAIRS = 60
#: Rows of a group of the lead-lag products, and the sums each group sends per lag and name.
LEAD_ROWS = 50_000
LEAD_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def wide_panel(
    df: DataFrame, spec: PanelSpec, names: Sequence[str], value: str | None = None
) -> DataFrame:
    """One row per timestamp, one column per entity; mean of duplicates."""
    return df.groupBy(spec.ts).pivot(spec.entity, list(names)).agg(F.avg(value or spec.target))


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _same(name: str) -> str:
    return name


def _pair_rows(
    wide: DataFrame,
    by: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    x: Callable[[str], str] = _same,
    y: Callable[[str], str] = _same,
    min_rows: int = 0,
) -> DataFrame:
    """(by, a, b, n, corr) for pairs of names, whose columns ``x`` and ``y`` give, from one pass. NaN is
    missing."""
    if len(pairs) > FEW_PAIRS:
        cols = list(dict.fromkeys([c for a, b in pairs for c in (x(a), y(b))]))
        at = {c: i for i, c in enumerate(cols)}
        return pair_table(materialize(wide), by, cols, [(a, b, at[x(a)], at[y(b)]) for a, b in pairs], min_rows)
    made = []
    for i, (a, b) in enumerate(pairs):
        u, v = null_if_nan(_q(x(a)).cast("double")), null_if_nan(_q(y(b)).cast("double"))
        n, r = F.count_if(u.isNotNull() & v.isNotNull()), safe_corr(u, v)
        r = F.when(n >= min_rows, r) if min_rows else r
        made.append(
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("corr")).alias(
                f"__p{i}"
            )
        )
    names = [f"__p{i}" for i in range(len(made))]
    return wide.groupBy(*by).agg(*made).select(*by, F.inline(F.array(*names)))


def corr_matrix(
    df: DataFrame,
    spec: PanelSpec,
    names: Sequence[str],
    method: str = "pearson",
    value: str | None = None,
) -> DataFrame:
    """Pairwise-complete correlations (a < b in the order of ``names``) in long form."""
    pairs = list(combinations(names, 2))
    wide = wide_panel(df, spec, names, value)
    if method == "pearson":
        return _pair_rows(wide, [], pairs)
    if method != "spearman":
        raise ValueError(f"unknown method: {method}")
    return _spearman(materialize(wide), spec, names, pairs)


def _spearman(wide: DataFrame, spec: PanelSpec, names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Ranks are taken among the complete rows of each pair. Those of a column depend only on where its
    partner is missing, so a column is ranked once for all partners that it is never without, and once
    for all others with gaps in the same places: one pass of ranks where nothing is missing."""
    k = len(names)
    row = pair_sums(wide, [], names).first()
    n = np.asarray(row["sums"]).reshape(4, k, k)[0] if row and row["sums"] else np.zeros((k, k))
    full = np.diag(n)
    alike = [next(j for j in range(k) if full[j] == full[i] == n[i, j]) if full[i] else i for i in range(k)]

    def series(i: int, j: int) -> tuple[int, int]:
        """Column i ranked where column j is present too; i itself where that leaves nothing out."""
        return (i, i) if n[i, j] == full[i] else (i, alike[j])

    at = {name: i for i, name in enumerate(names)}
    need = {(a, b): (series(at[a], at[b]), series(at[b], at[a])) for a, b in pairs}
    every = list(dict.fromkeys(s for both in need.values() for s in both))
    code = {s: f"__r{i}" for i, s in enumerate(every)}
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("s"),
                F.when(null_if_nan(_q(names[j]).cast("double")).isNotNull(), null_if_nan(_q(names[i]).cast("double"))).alias("v"),
            )
            for (i, j), c in code.items()
        ]
    )
    long = wide.select(spec.ts, F.explode(rows).alias("__p")).select(spec.ts, "__p.*").dropna(subset=["v"])
    total = spec.bounds.get(())
    plain = PanelSpec(
        entity="s", ts=spec.ts, id=spec.ts, chunk_rows=spec.chunk_rows, bucket_seconds=spec.bucket_seconds,
        bounds={("s",): GroupBound(0, total.total_rows, 0)} if total else {},
    )
    ranked = rank_pct(long, ["s"], ["v"], plain, "_rank")
    ranks = ranked.groupBy(spec.ts).pivot("s", list(code.values())).agg(F.max("v_rank"))
    coded = list(dict.fromkeys((code[u], code[v]) for u, v in need.values()))
    found = _pair_rows(ranks, [], coded).withColumnsRenamed({"a": "__a", "b": "__b"})
    label = wide.sparkSession.createDataFrame(
        [(a, b, code[u], code[v]) for (a, b), (u, v) in need.items()], "a string, b string, __a string, __b string"
    )
    return label.join(found, ["__a", "__b"]).select("a", "b", "n", "corr")


def corr_by(
    df: DataFrame,
    spec: PanelSpec,
    names: Sequence[str],
    grain: str,
    value: str | None = None,
    min_rows: int = 0,
) -> DataFrame:
    """Pair correlations by month (first day), hour or dow."""
    keys = {
        "month": F.trunc(F.to_date(spec.ts), "month"),
        "hour": F.hour(spec.ts),
        "dow": F.weekday(spec.ts),
    }
    wide = wide_panel(df, spec, names, value).withColumn(grain, keys[grain])
    return _pair_rows(wide, [grain], list(combinations(names, 2)), min_rows=min_rows)


def lead_lag(
    df: DataFrame,
    spec: PanelSpec,
    names: Sequence[str],
    anchor: str,
    lags: Sequence[int],
    value: str | None = None,
) -> DataFrame:
    """corr(anchor at t, other at t - lag) in timestamp positions, for every other entity."""
    others, far = [n for n in names if n != anchor], max(abs(k) for k in lags)
    wide = wide_panel(df, spec, names, value)
    numbers = {f"__c{i}": null_if_nan(_q(n).cast("double")) for i, n in enumerate([anchor, *others])}
    placed = materialize(positions(wide.select(spec.ts, *[c.alias(n) for n, c in numbers.items()]), [F.col(spec.ts)], "__pos"))
    means = placed.agg(*[F.avg(c).alias(c) for c in numbers]).first()
    centre = np.array([means[c] or 0.0 for c in numbers])
    # A run of rows, and the rows before it that its lags reach, are one group.
    size = max(min(spec.chunk_rows, LEAD_ROWS), far, 1)
    run = F.floor(F.col("__pos") / size)
    spread = placed.withColumn("__run", F.explode(F.sequence(run, F.floor((F.col("__pos") + far) / size))))
    steps, columns = list(lags), list(numbers)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        x = pdf[columns].to_numpy(dtype=float, na_value=np.nan) - centre
        own = np.flatnonzero(pdf["__pos"].to_numpy() // size == pdf["__run"].iloc[0])
        out = []
        for lag in steps:
            here = own[own >= abs(lag)]
            there = here - abs(lag)
            # A negative lag of the other side is the same pairing as a positive lag of the anchor.
            a, b = (x[here, :1], x[there, 1:]) if lag >= 0 else (x[there, :1], x[here, 1:])
            both = ~np.isnan(a) & ~np.isnan(b)
            u, v = np.where(both, a, 0.0), np.where(both, b, 0.0)
            sums = [both.sum(0), u.sum(0), v.sum(0), (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)]
            out.append(pd.DataFrame(np.array(sums, float).T, columns=LEAD_SUMS).assign(lag=int(lag), b=range(len(others))))
        return pd.concat(out)

    sums = spread.groupBy("__run").applyInPandas(
        products, ", ".join(f"{c} double" for c in LEAD_SUMS) + ", lag int, b int"
    )
    added = sums.groupBy("lag", "b").agg(*[F.sum(c).alias(c) for c in LEAD_SUMS])
    n, c = F.col("n"), F.col
    vx = F.try_divide(c("xx"), n) - F.pow(F.try_divide(c("x"), n), F.lit(2.0))
    vy = F.try_divide(c("yy"), n) - F.pow(F.try_divide(c("y"), n), F.lit(2.0))
    moving = (vx > 1e-12 * F.try_divide(c("xx"), n)) & (vy > 1e-12 * F.try_divide(c("yy"), n))
    cross = F.try_divide(c("xy"), n) - F.try_divide(c("x"), n) * F.try_divide(c("y"), n)
    name = F.array(*[F.lit(o) for o in others])
    return added.select(
        F.lit(anchor).alias("a"), F.get(name, "b").alias("b"), "lag", F.when(moving, cross / F.sqrt(vx * vy)).alias("corr")
    )


def best_lag(table: DataFrame) -> DataFrame:
    """Per pair the lag of largest absolute correlation (the smallest such lag)."""
    size = F.abs("corr")
    best = F.when(size.isNotNull(), F.struct(size.alias("s"), (-F.col("lag")).alias("l")))
    return table.groupBy("a", "b").agg(
        F.max_by("lag", best).alias("lag"),
        F.max_by("corr", best).alias("corr"),
        F.max(size).alias("abs_corr"),
    )


def _by_feature(
    df: DataFrame, spec: PanelSpec, names: Sequence[str], cols: Sequence[str], target: bool
) -> DataFrame:
    """One row per (feature, ts) with ``f_<i>`` (and ``t_<i>``) for the i-th entity."""
    feature = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]
    )
    long = df.select(
        spec.ts, spec.entity, F.col(spec.target).alias("__t"), F.explode(feature).alias("__f")
    ).select(spec.ts, spec.entity, "__t", "__f.*")
    return long.groupBy("feature", spec.ts).agg(
        *[
            F.avg(F.when(F.col(spec.entity) == name, F.col("v"))).alias(f"f_{i}")
            for i, name in enumerate(names)
        ],
        *(
            F.avg(F.when(F.col(spec.entity) == name, F.col("__t"))).alias(f"t_{i}")
            for i, name in enumerate(names)
            if target
        ),
    )


def coupling_strength(
    df: DataFrame, spec: PanelSpec, names: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Per feature: mean, mean absolute, std, min and max of its pair correlations."""
    at = {name: f"f_{i}" for i, name in enumerate(names)}
    pairs = _pair_rows(
        _by_feature(df, spec, names, cols, False),
        ["feature"],
        list(combinations(names, 2)),
        x=lambda n: at[n],
        y=lambda n: at[n],
    )
    return pairs.groupBy("feature").agg(
        F.avg("corr").alias("mean_corr"),
        F.avg(F.abs("corr")).alias("mean_abs_corr"),
        F.stddev_samp("corr").alias("std_corr"),
        F.min("corr").alias("min_corr"),
        F.max("corr").alias("max_corr"),
    )


def feature_target_map(
    df: DataFrame, spec: PanelSpec, names: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """corr(feature in entity a, target in entity b) for all ordered pairs."""
    at = {name: i for i, name in enumerate(names)}
    return _pair_rows(
        _by_feature(df, spec, names, cols, True),
        ["feature"],
        list(product(names, names)),
        x=lambda n: f"f_{at[n]}",
        y=lambda n: f"t_{at[n]}",
    )


def same_and_cross(table: DataFrame) -> DataFrame:
    """Mean correlation within and across entities per feature."""
    same = F.col("a") == F.col("b")
    return table.groupBy("feature").agg(
        F.avg(F.when(same, F.col("corr"))).alias("mean_same"),
        F.avg(F.when(~same, F.col("corr"))).alias("mean_cross"),
    )


def prediction_similarity(
    long: DataFrame,
    runs: Sequence[str],
    by: Sequence[str] | str = (),
    key: str = "id",
    pred: str = "pred",
    min_rows: int = 3,
) -> DataFrame:
    """Pair correlations of runs from (run, id, pred), overall or by columns of the row."""
    by = as_list(by)
    wide = long.groupBy(key, *by).pivot("run", list(runs)).agg(F.avg(pred))
    return _pair_rows(wide, by, list(combinations(runs, 2)), min_rows=min_rows)


def lowest_pairs(table: DataFrame, k: int) -> DataFrame:
    return first_rows(table, [F.col("corr").isNull(), F.col("corr"), F.col("a"), F.col("b")], k)


def against(table: DataFrame, reference: str) -> DataFrame:
    """Correlation of every other run to the reference run."""
    hit = table.filter((F.col("a") == reference) | (F.col("b") == reference))
    other = F.when(F.col("a") == reference, F.col("b")).otherwise(F.col("a"))
    return hit.withColumn("run", other).drop("a", "b")
