"""Walk-forward splits as small tables of half-open bounds.

Every rule returns ``fold, train_end, val_start, val_end``: training rows have ts < train_end,
validation rows val_start <= ts < val_end, and a NULL end is open. ``assign_folds`` turns rows
into (row, fold, role) without a join on ranges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.plans.layout import PanelSpec, attach, row_scalars, time_bucket
from panelkit.sources.io import materialize

COLUMNS = ["fold", "train_end", "val_start", "val_end"]
# Bucket widths (seconds) through which a position among all timestamps is located.
POSITION_WIDTHS = (86400.0, 1.0)


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the surviving folds from 1 in their order (at most a few rows per key)."""
    keys = list(keys)
    span = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__k")
    return rows.withColumn("fold", F.row_number().over(span)).select(*keys, *COLUMNS)


def _day_list(df: DataFrame, spec: PanelSpec, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct days per group; its length is bounded by the calendar."""
    days = df.select(*keys, F.to_date(spec.ts).alias("__d")).filter(F.col("__d").isNotNull())
    return (
        days.distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__d")).alias("__days"))
        .withColumn("__n", F.size("__days"))
    )


def _by_days(
    df: DataFrame,
    spec: PanelSpec,
    n: int,
    keys: Sequence[str],
    rule: Callable[[Column, Column], tuple[Column, Column, Column, Column]],
) -> DataFrame:
    """Folds from day positions: ``rule(k, days)`` gives (train_end, val_start, val_end, keep)
    as positions in the day list, ends exclusive."""
    rows = _day_list(df, spec, keys).withColumn(
        "__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    train_end, val_start, val_end, keep = rule(F.col("__k"), F.col("__n"))

    def after(position: Column) -> Column:
        day = F.element_at("__days", position.cast("int"))
        return F.date_add(day, 1).cast("timestamp_ntz")

    first = F.element_at("__days", (val_start + 1).cast("int")).cast("timestamp_ntz")
    return _numbered(
        rows.filter(keep).withColumns(
            {"train_end": after(train_end), "val_start": first, "val_end": after(val_end)}
        ),
        keys,
    )


def _forward(n: int, purge: int, min_train: int, least: int):
    """Expanding folds of equal size after a purge gap."""

    def rule(k: Column, total: Column):
        size = F.greatest(F.lit(least), F.floor(total / (n + 1)))
        train_end = size * (k + 1)
        start = train_end + purge
        end = F.least(start + size, total)
        keep = (total >= n + 2) & (train_end >= min_train) & (end > start)
        return train_end, start, end, keep

    return rule


def timestamp_folds(
    df: DataFrame, spec: PanelSpec, n: int, purge: int, min_train: int, least: int = 24
) -> DataFrame:
    """Expanding folds over distinct timestamps.

    Timestamps at fold positions are found through counts per day and second, so the full list is
    never gathered in one place.
    """
    times = df.select(spec.ts).filter(F.col(spec.ts).isNotNull()).distinct()
    times = materialize(times)  # read several times below, and far smaller than the panel
    total = times.count()
    size = max(least, total // (n + 1))
    spots = []
    for train_end in range(size, size * n + 1, size):
        start = train_end + purge
        end = min(start + size, total)
        if total >= n + 2 and train_end >= min_train and end > start:
            spots.append((train_end, start, end))
    form = "fold int, train_end timestamp_ntz, val_start timestamp_ntz, val_end timestamp_ntz"
    if not spots:
        return df.sparkSession.createDataFrame([], form)
    wanted = F.array(*[F.lit(p).cast("long") for p in sorted({p for s in spots for p in s})])

    # Days holding a wanted position, then seconds of those days, then their timestamps.
    left = times.withColumn("__before", F.lit(0).cast("long"))
    group: list[str] = []
    for width in POSITION_WIDTHS:
        left = left.withColumn("__b", time_bucket(spec.ts, width))
        counts = left.groupBy(*group, "__b").agg(
            F.count(F.lit(1)).alias("__m"), F.max("__before").alias("__base")
        )
        past = W.partitionBy(*(group or [F.lit(0)])).orderBy("__b")
        passed = F.sum("__m").over(past.rowsBetween(W.unboundedPreceding, -1))
        counts = counts.withColumn("__from", F.col("__base") + F.coalesce(passed, F.lit(0)))
        here = F.col("__from"), F.col("__from") + F.col("__m")
        hit = counts.filter(F.exists(wanted, lambda p: (p >= here[0]) & (p < here[1])))
        left = (
            attach(left.drop("__before"), hit.select(*group, "__b", "__from"), [*group, "__b"], how="inner")
            .drop("__group")
            .withColumnsRenamed({"__from": "__before", "__b": "__group"})
        )
        group = ["__group"]
    place = W.partitionBy("__group").orderBy(spec.ts)
    found = left.withColumn("__p", F.col("__before") + F.row_number().over(place) - 1)
    # At most three timestamps per fold.
    at = {r["__p"]: r[spec.ts] for r in found.filter(F.array_contains(wanted, F.col("__p"))).collect()}
    rows = [(i, *[at.get(p) for p in spot]) for i, spot in enumerate(spots, 1)]
    return df.sparkSession.createDataFrame(rows, form)


def entity_day_folds(
    df: DataFrame, spec: PanelSpec, n: int, purge_days: int, min_train_days: int, least: int = 2
) -> DataFrame:
    """Expanding folds over each entity's own days."""
    return _by_days(df, spec, n, [spec.entity], _forward(n, purge_days, min_train_days, least))


def rolling_day_folds(
    df: DataFrame, spec: PanelSpec, n: int, val_days: int, step_days: int, min_train_days: int
) -> DataFrame:
    """Last-anchored folds over the day list, the last day included."""

    def rule(k: Column, total: Column):
        end = total - (F.lit(n - 1) - k) * step_days
        start = end - val_days
        keep = (total >= val_days + min_train_days) & (start > 0) & (start >= min_train_days)
        return start, start, end, keep

    return _by_days(df, spec, n, [], rule)


def rolling_date_folds(
    df: DataFrame,
    spec: PanelSpec,
    n: int,
    val_days: int,
    step_days: int,
    min_train_days: int,
    end_exclusive: bool = True,
) -> DataFrame:
    """Last-anchored folds by calendar date, stopping where history gets short.

    With ``end_exclusive`` the last fold ends at the start of the last day, which is therefore
    never validated; without it all folds move one day later.
    """
    day = F.to_date(spec.ts)
    span = df.agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
    extra = 0 if end_exclusive else 1
    rows = span.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    end = F.date_add(F.date_sub("__last", F.lit(step_days) * F.col("__k")), extra)
    start = F.date_sub(end, val_days)
    rows = rows.withColumns(
        {
            "val_start": start.cast("timestamp_ntz"),
            "val_end": end.cast("timestamp_ntz"),
            "train_end": start.cast("timestamp_ntz"),
            "__ok": start > F.date_add("__first", min_train_days),
        }
    )
    return _numbered(rows.filter("__ok").withColumn("__k", -F.col("__k")), [])


def stack_folds(df: DataFrame, spec: PanelSpec, n: int, min_train_days: int) -> DataFrame:
    """Forward folds that start after ``min_train_days`` days."""

    def rule(k: Column, total: Column):
        size = F.greatest(F.lit(1), F.floor(total / (n + 1)).cast("int"))
        start = F.lit(min_train_days) + k * size
        keep = (total >= min_train_days + n) & (start < total)
        return start, start, F.least(start + size, total), keep

    return _by_days(df, spec, n, [], rule)


def recent_holdout(df: DataFrame, spec: PanelSpec, days: int) -> DataFrame:
    """Rows with ``role``: holdout for the last ``days`` days before the newest row, else train."""
    last = row_scalars(df.agg(F.max(spec.ts).alias("t")))["t"]
    cutoff = last - F.make_dt_interval(F.lit(max(days, 1)))
    role = F.when(F.col(spec.ts) >= cutoff, "holdout").when(F.col(spec.ts) < cutoff, "train")
    return df.withColumn("role", role)


def assign_folds(
    df: DataFrame, folds: DataFrame, spec: PanelSpec, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (row, fold) with ``fold`` and ``role`` (train / val).

    The few folds travel as one array, overall or per entity."""
    keys = list(keys)
    packed = folds.groupBy(*keys).agg(F.collect_list(F.struct(*COLUMNS)).alias("__folds"))
    if keys:
        df = attach(df, packed, keys, spec.table_rows())
    else:
        df = df.withColumn("__folds", row_scalars(packed)["__folds"])
    t = F.col(spec.ts)

    def role(f: Column) -> Column:
        validates = (t >= f.val_start) & (f.val_end.isNull() | (t < f.val_end))
        return F.when(t < f.train_end, "train").when(validates, "val")

    tagged = F.transform(
        "__folds", lambda f: F.struct(f.fold.alias("fold"), role(f).alias("role"))
    )
    return (
        df.withColumn("__f", F.explode(F.filter(tagged, lambda x: x.role.isNotNull())))
        .withColumns({"fold": F.col("__f.fold"), "role": F.col("__f.role")})
        .drop("__f", "__folds")
    )
