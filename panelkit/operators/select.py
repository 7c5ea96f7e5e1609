"""Filters and projections over panels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import flag, wall_clock
from panelkit.plans.layout import PanelSpec, attach
from panelkit.plans.ranks import first_rows

# Salts a large group is spread over, step by step.
SALTS = (2**18, 2**9)


def _at(year: int, month: int = 1):
    return wall_clock(date(year, month, 1))


def exclude_year(df: DataFrame, year: int, keep_from_month: int, ts: str = "ts") -> DataFrame:
    """Drop a year except its months from ``keep_from_month`` on.

    Written as a range of ``ts`` so that it reaches the scan."""
    upper = _at(year, keep_from_month) if keep_from_month <= 12 else _at(year + 1)
    return df.filter((F.col(ts) < _at(year)) | (F.col(ts) >= upper))


def start_cutoff(df: DataFrame, start: str | date, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` on."""
    return df.filter(F.col(ts) >= wall_clock(start))


def entity_cutoff(
    df: DataFrame, params: DataFrame, min_rows: int, spec: PanelSpec, start: str = "train_start"
) -> DataFrame:
    """Per-entity start from ``params`` (entity, start), ignored where it is missing or would
    leave fewer than ``min_rows`` rows."""
    e = spec.entity
    given = params.select(e, F.col(start).cast("timestamp_ntz").alias("__start"))
    rows = spec.table_rows()
    after = (
        attach(df.select(e, spec.ts), given, [e], rows)
        .groupBy(e)
        .agg(
            F.max("__start").alias("__start"),
            F.sum(flag(F.col(spec.ts) >= F.col("__start"))).alias("__n"),
        )
        .filter(F.col("__n") >= min_rows)
        .select(e, "__start")
    )
    return (
        attach(df, after, [e], rows)
        .filter(F.col("__start").isNull() | (F.col(spec.ts) >= F.col("__start")))
        .drop("__start")
    )


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at most one distinct value, NULL counting as a value; one narrow aggregate."""
    aggs = []
    for c in cols:
        x = F.col(c)
        mixed = (F.count(x) > 0) & (F.count(x) < F.count(F.lit(1)))
        aggs.append((mixed | F.coalesce(F.min(x) != F.max(x), F.lit(False))).alias(c))
    row = df.agg(*aggs).first()
    return [c for c in cols if not row[c]]


def drop_constant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, cols))


def ensure_columns(
    df: DataFrame, cols: Sequence[str], cat_cols: Sequence[str] = ()
) -> DataFrame:
    """Add absent columns (``__MISSING__`` for categories, 0 for counts, else NULL), turn
    booleans into doubles, fill missing categories, and put ``cols`` in order."""
    kinds = dict(df.dtypes)
    made = {}
    for c in cols:
        if c in cat_cols:
            value = F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")
            made[c] = F.coalesce(value, F.lit("__MISSING__"))
        elif c not in kinds:
            made[c] = F.lit(0.0) if c.endswith("_count") else F.lit(None).cast("double")
        elif kinds[c] == "boolean":
            made[c] = F.col(c).cast("double")
    return df.withColumns(made) if made else df


def tag_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training and test rows in one frame, so that lags cross the boundary."""
    return train.withColumn("_is_train", F.lit(1)).unionByName(
        test.withColumn("_is_train", F.lit(0)), allowMissingColumns=True
    )


def untag(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        df.filter(F.col("_is_train") == 1).drop("_is_train"),
        df.filter(F.col("_is_train") == 0).drop("_is_train"),
    )


def sample_rows(
    df: DataFrame, n: int, spec: PanelSpec, by: Sequence[str] | None = None, seed: int = 0
) -> DataFrame:
    """``n`` rows overall, or per group of ``by``, chosen by a seeded hash of the id.

    The same rows are chosen whatever the partitioning. A large group is cut to ``n`` rows per
    salt, with fewer salts each time, so its rows never meet in one task.
    """
    pick = F.md5(F.concat(F.col(spec.id).cast("string"), F.lit(f":{seed}")))
    if not by:
        return first_rows(df, [pick, F.col(spec.id)], n)
    order = [F.col("__pick"), F.col(spec.id)]
    out = df.withColumn("__pick", pick)
    for salts in [1] if spec.bounded(by) else [*SALTS, 1]:
        out = out.withColumn("__salt", F.crc32("__pick") % salts)
        rank = F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*order))
        out = out.withColumn("__rank", rank).filter(F.col("__rank") <= n)
    return out.drop("__pick", "__salt", "__rank")
