"""Joins with checks, alignment of prediction tables, and lookups with backoff."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import as_list
from panelkit.plans.layout import PanelSpec, attach


def _sources(frames: Mapping[str, DataFrame], *cols: str) -> DataFrame:
    """The frames' columns under each other with the source's position as ``__src``."""
    out = None
    for i, df in enumerate(frames.values()):
        part = df.select(F.lit(i).alias("__src"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def _has(i: int) -> Column:
    return F.sum((F.col("__src") == i).cast("int"))


def _everywhere(n: int) -> Column:
    """Whether the group has rows of all n sources."""
    out = F.lit(True)
    for i in range(n):
        out = out & F.bool_or(F.col("__src") == i)
    return out


def join_one_to_one(a: DataFrame, b: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Left join that fails if a key repeats on either side or has no match in ``b``.

    All three checks share one aggregate over the keys.
    """
    key = as_list(key)
    counts = _sources({"a": a, "b": b}, *key).groupBy(*key).agg(
        _has(0).alias("__a"), _has(1).alias("__b")
    )
    row = counts.agg(
        F.max("__a"), F.max("__b"), F.count_if((F.col("__a") > 0) & (F.col("__b") == 0))
    ).first()
    if (row[0] or 0) > 1 or (row[1] or 0) > 1:
        raise ValueError(f"keys {key} are not unique: {row[0]} / {row[1]} rows of one key")
    if row[2]:
        raise ValueError(f"{row[2]} rows without a match on {key}")
    return a.join(b, key, "left")


def align_predictions(
    preds: Mapping[str, DataFrame], key: str = "id", value: str = "target"
) -> DataFrame:
    """Ids present in every table, one column per table; one shuffle for any number of tables."""
    out = _sources(preds, key, value).groupBy(key).agg(
        *[
            F.max(F.when(F.col("__src") == i, F.col(value))).alias(name)
            for i, name in enumerate(preds)
        ],
        _everywhere(len(preds)).alias("__all"),
    )
    return out.filter("__all").drop("__all")


def id_differences(preds: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """Per table: ids it lacks and ids only it has."""
    per_id = _sources(preds, key).groupBy(key).agg(
        *[F.max((F.col("__src") == i).cast("int")).alias(f"__h{i}") for i in range(len(preds))]
    )
    hits = sum((F.col(f"__h{i}") for i in range(len(preds))), F.lit(0))
    total = per_id.agg(
        *[
            F.struct(
                F.lit(name).alias("source"),
                F.coalesce(F.sum(1 - F.col(f"__h{i}")), F.lit(0)).alias("missing"),
                F.count_if((F.col(f"__h{i}") == 1) & (hits == 1)).alias("only_here"),
            ).alias(f"__r{i}")
            for i, name in enumerate(preds)
        ]
    )
    rows = F.array(*[F.col(f"__r{i}") for i in range(len(preds))])
    return total.select(F.inline(rows))


def assert_same_ids(preds: Mapping[str, DataFrame], key: str = "id") -> None:
    bad = [r for r in id_differences(preds, key).collect() if r["missing"]]
    if bad:
        raise ValueError(f"tables lack ids: {[(r['source'], r['missing']) for r in bad]}")


def lookup_backoff(
    df: DataFrame,
    cell: DataFrame,
    entity: DataFrame,
    overall: Mapping[str, Column],
    names: Sequence[str],
    spec: PanelSpec,
    cell_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Each of ``names`` from the cell table, else the entity table, else overall.

    The tables hold the columns of ``names``; existing columns of that name are replaced.
    """
    bound = None if cell_keys else spec.table_rows(25)  # own keys may have any number of cells
    cell_keys = list(cell_keys or [spec.entity, "hour"])
    rename = {n: f"__c_{n}" for n in names}, {n: f"__e_{n}" for n in names}
    out = attach(
        df.drop(*names),
        cell.select(*cell_keys, *names).withColumnsRenamed(rename[0]),
        cell_keys,
        bound,
    )
    out = attach(
        out,
        entity.select(spec.entity, *names).withColumnsRenamed(rename[1]),
        [spec.entity],
        spec.table_rows(),
    )
    return out.withColumns(
        {n: F.coalesce(F.col(f"__c_{n}"), F.col(f"__e_{n}"), overall[n]) for n in names}
    ).drop(*rename[0].values(), *rename[1].values())


def ordered_bounds(df: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Swap the bounds where high < low."""
    swap = F.col(high) < F.col(low)
    return df.withColumns(
        {
            low: F.when(swap, F.col(high)).otherwise(F.col(low)),
            high: F.when(swap, F.col(low)).otherwise(F.col(high)),
        }
    )


def mismatch_report(
    frames: Mapping[str, DataFrame], key: str = "id", value: str = "target", ts: str = "ts"
) -> DataFrame:
    """Against the first frame, on ids present in all: largest value difference and number of
    differing timestamps."""
    names = list(frames)
    n = len(names)
    per_id = (
        _sources(frames, key, value, ts)
        .groupBy(key)
        .agg(
            *[F.max(F.when(F.col("__src") == i, F.col(value))).alias(f"__v{i}") for i in range(n)],
            *[F.max(F.when(F.col("__src") == i, F.col(ts))).alias(f"__t{i}") for i in range(n)],
            _everywhere(n).alias("__all"),
        )
        .filter("__all")
    )
    total = per_id.agg(
        *[
            F.struct(
                F.lit(names[i]).alias("source"),
                F.max(F.abs(F.col(f"__v{i}") - F.col("__v0"))).alias("max_abs_diff"),
                F.count_if(~F.col(f"__t{i}").eqNullSafe(F.col("__t0"))).alias("ts_mismatches"),
                F.count(F.lit(1)).alias("rows"),
            ).alias(f"__r{i}")
            for i in range(1, n)
        ]
    )
    return total.select(F.inline(F.array(*[F.col(f"__r{i}") for i in range(1, n)])))


def distinct_rows(
    df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str
) -> DataFrame:
    """One row per key: the smallest in ``order``. A combined aggregate, so many copies of one
    key are reduced before the shuffle."""
    keys, order = as_list(keys), as_list(order)
    row = F.struct(*df.columns)
    return (
        df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys])
        .agg(F.min_by(row, F.struct(*order)).alias("__row"))
        .select("__row.*")
    )
