"""Exact order statistics that never put a whole group in one task.

Values are located through two levels of value buckets: a logarithmic one (a fixed function of
the value) and an even split of each bucket's own range. Bucket counts are carried forward, so
only the rows of one small bucket are ever sorted together. Ranks need every (group, value) in
its place; quantiles count the logarithmic buckets in one pass and, in a second one, take only the
values of buckets that hold a wanted place. Groups proven small use the built-in ``percentile``
or one window instead. NaN and infinity are missing values on both routes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import col
from panelkit.plans.layout import PanelSpec, attach
from panelkit.sources.io import materialize

PER_OCTAVE = 256
FINE = 16_384
# Logarithmic buckets an octave that quantiles count first. Fewer, so that each task's counts stay
# small; their own range is split the more finely.
COUNTED_PER_OCTAVE = 32


def finite(v: Column | str) -> Column:
    """The value, NULL if it is NaN or infinite."""
    v = col(v)
    return F.when(F.abs(v.cast("double")) < float("inf"), v)  # NaN is above infinity


def _coarse(v: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Non-decreasing whole number of a double: sign and 1/256 octave of its size."""
    size = F.floor(F.log2(F.abs(v)) * per_octave) + F.lit(1100 * per_octave)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("int") * size).cast("long")


def _fine(v: Column, parts: int) -> Column:
    """Which of ``parts`` even parts of its bucket's range (__lo, __hi) a value is in."""
    share = F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return F.coalesce(F.floor(share * (parts - 1)), F.lit(0))


def _located(d: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """Add __b1, __b2 and __base (weight in smaller buckets) to rows (keys, value, n)."""
    keys = list(keys)
    d = d.withColumn("__b1", _coarse(F.col(value)))
    first = (
        d.groupBy(*keys, "__b1")
        .agg(F.sum(n).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        .withColumn("__off1", _before("__n", keys, "__b1"))
        .drop("__n")
    )
    d = attach(d, first, [*keys, "__b1"]).withColumn("__b2", _fine(F.col(value), FINE))
    second = (
        d.groupBy(*keys, "__b1", "__b2")
        .agg(F.sum(n).alias("__n"))
        .withColumn("__off2", _before("__n", [*keys, "__b1"], "__b2"))
        .drop("__n")
    )
    return (
        attach(d, second, [*keys, "__b1", "__b2"])
        .withColumn("__base", F.col("__off1") + F.col("__off2"))
        .drop("__off1", "__off2", "__lo", "__hi")
    )


def _before(n: str, keys: Sequence[str], order: str) -> Column:
    past = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(past), F.lit(0))


def weight_below(
    d: DataFrame, keys: Sequence[str], value: str, n: str, spec: PanelSpec, name: str = "below"
) -> DataFrame:
    """For rows (keys, value, n) unique in (keys, value): total ``n`` of smaller values. Missing,
    NaN and infinite values come out as NULL with a NULL total and count for no other row."""
    keys = list(keys)
    d = d.withColumn(value, finite(value))
    present = F.col(value).isNotNull()
    if spec.bounded(keys):
        d = d.withColumn("__w", F.when(present, F.col(n)))
        return d.withColumn(name, F.when(present, _before("__w", keys, value))).drop("__w")
    out = _located(d.filter(present), keys, value, n)
    inside = _before(n, [*keys, "__b1", "__b2"], value)
    out = out.withColumn(name, F.col("__base") + inside).drop("__b1", "__b2", "__base")
    return out.unionByName(d.filter(~present).withColumn(name, F.lit(None)))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[Column | str, float]],
    spec: PanelSpec,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group; NULL, NaN and infinity skipped.

    ``wanted`` maps an output name to (value expression, q). Every group of ``keys`` is kept,
    with NULL where it has no value. With no keys one row comes back. Groups not proven small are
    computed at once, in two passes over ``df``: what comes back is a stored table whose plan
    does not hold that of ``df``, so that quantiles of frames made from quantiles stay small plans.
    """
    keys = list(keys)
    if spec.bounded(keys):
        return df.groupBy(*keys).agg(
            *[F.percentile(finite(c), F.lit(float(q))).alias(a) for a, (c, q) in wanted.items()]
        )

    # One long row per distinct value expression.
    exprs: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
    for alias, (c, q) in wanted.items():
        expr = col(c)
        exprs.setdefault(str(expr), (expr, []))[1].append((alias, float(q)))
    series = list(exprs.values())
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("s"), finite(e).cast("double").alias("v"))
                    for i, (e, _) in enumerate(series)
                ]
            )
        ).alias("__x"),
    ).select(*keys, F.col("__x.s").alias("__s"), F.col("__x.v").alias("__v"))
    # First pass: counts and ranges of the logarithmic buckets. Missing values make a bucket of their
    # own (NULL), so that every group is there.
    long = long.withColumn("__b1", _coarse(F.col("__v"), COUNTED_PER_OCTAVE))
    group = [*keys, "__s"]
    buckets = materialize(
        long.groupBy(*group, "__b1").agg(
            F.count(F.lit(1)).alias("__w"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
        )
    )
    present = buckets.filter(F.col("__b1").isNotNull())
    totals = present.groupBy(*group).agg(F.sum("__w").alias("__total"))
    asks = F.array(
        *[
            F.struct(
                F.lit(i).alias("s"), F.lit(alias).alias("a"), F.lit(q).alias("q")
            )
            for i, (_, qs) in enumerate(series)
            for alias, q in qs
        ]
    )
    ranks = (
        totals.withColumn("__ask", F.explode(F.filter(asks, lambda x: x.s == F.col("__s"))))
        .withColumn("__pos", F.col("__ask.q") * (F.col("__total") - 1))
        .select(
            *group,
            F.col("__ask.a").alias("__alias"),
            "__pos",
            F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos")))).alias("__rank"),
        )
    )
    wanted_buckets = materialize(
        _hit(present.withColumn("__off", _before("__w", group, "__b1")), ranks, group, ["__b1", "__lo", "__hi", "__off"])
    )
    # Second pass: the values of those buckets alone, counted, in even parts of the bucket's range.
    inside = attach(long, wanted_buckets.drop("__asked"), [*group, "__b1"], how="inner")
    counted = materialize(
        inside.groupBy(*group, "__b1", "__lo", "__hi", "__off", "__v").agg(F.count(F.lit(1)).alias("__n"))
    )
    parts = FINE * PER_OCTAVE // COUNTED_PER_OCTAVE
    placed = counted.withColumn("__b2", _fine(F.col("__v"), parts)).drop("__lo", "__hi")
    spans = placed.groupBy(*group, "__b1", "__off", "__b2").agg(F.sum("__n").alias("__w"))
    spans = spans.withColumn("__off", F.col("__off") + _before("__w", [*group, "__b1"], "__b2"))
    # Keep only the parts that hold a wanted rank, then walk each of those in value order.
    hit = _hit(spans, ranks, group, ["__b1", "__b2", "__off"])
    walked = attach(placed.drop("__off"), hit, [*group, "__b1", "__b2"], how="inner").withColumn(
        "__from", F.col("__off") + _before("__n", [*group, "__b1", "__b2"], "__v")
    )
    picked = (
        walked.withColumn("__ask", F.explode("__asked"))
        .filter(
            (F.col("__ask.__rank") >= F.col("__from"))
            & (F.col("__ask.__rank") < F.col("__from") + F.col("__n"))
        )
        .select(
            *keys,
            F.col("__ask.__alias").alias("__alias"),
            F.col("__v"),
            (F.col("__ask.__pos") - F.floor("__ask.__pos")).alias("__frac"),
        )
        .groupBy(*keys, "__alias")
        .agg(
            F.min("__v").alias("__low"),
            F.max("__v").alias("__high"),
            F.max("__frac").alias("__frac"),
        )
        .withColumn("__q", F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__frac"))
    )
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__alias") == a, F.col("__q"))).alias(a) for a in wanted]
    )
    if keys:
        wide = attach(buckets.select(*keys).distinct(), wide, keys)
    return materialize(wide)


def _hit(spans: DataFrame, ranks: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The spans (group, names, weight __w from place __off on) that hold wanted ranks, with those as __asked."""
    at = F.col("__rank") - F.col("__off")
    held = attach(spans, ranks, group, how="inner").filter((at >= 0) & (at < F.col("__w")))
    return held.groupBy(*group, *names).agg(F.collect_list(F.struct("__alias", "__pos", "__rank")).alias("__asked"))


def rank_pct(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], spec: PanelSpec, suffix: str
) -> DataFrame:
    """Average-tie percent rank of each column within its group; NULL, NaN and infinity get NULL."""
    keys = list(keys)
    if spec.bounded(keys):
        out = {}
        for c in columns:
            v = f"__v_{c}"
            group = W.partitionBy(*keys)
            peers = F.count(v).over(W.partitionBy(*keys, v))
            first = F.rank().over(group.orderBy(F.col(v).asc_nulls_last()))
            out[c + suffix] = F.when(
                F.col(v).isNotNull(),
                (first + (peers - 1) / F.lit(2.0)) / F.count(v).over(group),
            )
        values = {f"__v_{c}": finite(c) for c in columns}
        return df.withColumns(values).withColumns(out).drop(*values)
    for c in columns:
        counted = df.filter(finite(c).isNotNull()).groupBy(*keys, c).agg(F.count(c).alias("__n"))
        totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"))
        pct = (
            attach(weight_below(counted, keys, c, "__n", spec, "__below"), totals, keys)
            .withColumn(
                c + suffix,
                (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)) / F.col("__all"),
            )
            .select(*keys, c, c + suffix)
        )
        df = attach(df, pct, [*keys, c])
    return df


def positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add each row's place (from 0) in a total order, whatever the number of rows.

    Rows are dealt out by range and counted per range; the counts of the ranges before give each
    range its offset, so no task orders more than its range."""
    dealt = materialize(
        df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    )
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row per range
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return (
        dealt.join(F.broadcast(offsets), "__range")
        .withColumn(out, F.col("__off") + inside - 1)
        .drop("__range", "__off")
    )


#: Rows up to which the first n of an order are gathered in one task.
GATHERED = 100_000


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order in which no two rows are equal; missing values come first (put
    ``isNull()`` before a column to have them last).

    A small n is one top-n per task. A large one finds the last row's place among range-partitioned keys and
    filters by it, so that only keys are moved and no task orders more than its range. Rows equal to
    the last one in the whole order come along."""
    if n <= GATHERED:
        return df.orderBy(F.struct(*order)).limit(n)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    placed = positions(df.select(key.alias("__key")), [F.col("__key")], "__pos")
    last = placed.filter(F.col("__pos") == n - 1).agg(F.max("__key").alias("__last"))
    cut = last.scalar()
    return df.filter(cut.isNull() | (key <= cut))
