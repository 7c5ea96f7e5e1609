"""How a panel is laid out over tasks.

A panel may have few entities with very long histories, so ``partitionBy(entity)`` alone can
put a third of all rows in one task. ``PanelSpec.measured`` records proven group bounds with one
small aggregate. Where a group is proven small the plain window is used; otherwise

* row frames run on (entity, chunk) partitions. A chunk is a run of consecutive time buckets
  holding about ``chunk_rows`` rows, and the ``halo`` rows before it are copied in, so lags and
  rolling frames see exactly the rows they would see in one long partition;
* running totals run in two levels: totals per (keys, bucket) carried forward, plus a window
  inside the bucket.

Both ways give the same rows; an unmeasured spec always takes the second.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelkit.functions.contract import as_list, epoch_micros

# Widths tried for the time buckets of a long history, widest first (seconds).
BUCKET_WIDTHS = (30 * 86400.0, 86400.0, 3600.0, 60.0, 1.0, 0.001)
# Rows up to which a table is broadcast; its size must be proven, never guessed.
BROADCAST_ROWS = 100_000
# Time buckets carried together in running sums over a long history.
SPAN = 4096


@dataclass(frozen=True)
class GroupBound:
    groups: int
    max_rows: int
    total_rows: int


@dataclass(frozen=True)
class PanelSpec:
    """Names of the panel's columns plus what has been proven about its group sizes."""

    entity: str = "entity"
    ts: str = "ts"
    id: str = "id"
    target: str = "target"
    chunk_rows: int = 250_000
    bucket_seconds: float = 86400.0
    bounds: Mapping[tuple[str, ...], GroupBound] = field(default_factory=dict)

    @property
    def order(self) -> list[Column]:
        return [F.col(self.ts), F.col(self.id)]

    def measured(self, df: DataFrame, *key_sets: Sequence[str] | str) -> PanelSpec:
        """Spec with the group bounds of ``df`` by entity (and by each given key set)."""
        spec = self
        for keys in [(self.entity,), *[tuple(as_list(k)) for k in key_sets]]:
            row = (
                df.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("n"))
                .agg(F.count(F.lit(1)), F.max("n"), F.sum("n"))
                .first()
            )
            bound = GroupBound(row[0] or 0, row[1] or 0, row[2] or 0)
            everything = GroupBound(1, bound.total_rows, bound.total_rows)
            spec = replace(spec, bounds={**spec.bounds, keys: bound, (): everything})
        if not spec.bounded([spec.entity]):
            spec = replace(spec, bucket_seconds=_bucket_width(df, spec))
        return spec

    def bounded(self, keys: Sequence[str]) -> bool:
        """True if no group by ``keys`` can hold more than ``chunk_rows`` rows.

        Groups by a superset of a measured key set are never larger than the measured ones.
        """
        have = set(keys)
        return any(
            set(k) <= have and b.max_rows <= self.chunk_rows for k, b in self.bounds.items()
        )

    def table_rows(self, cells: int = 1) -> int | None:
        """Proven row bound of a table with at most ``cells`` rows per entity."""
        bound = self.bounds.get((self.entity,))
        return bound.groups * cells if bound else None


def _bucket_width(df: DataFrame, spec: PanelSpec) -> float:
    for width in BUCKET_WIDTHS:
        row = (
            df.groupBy(spec.entity, time_bucket(spec.ts, width).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n"))
            .first()
        )
        if row[0] is None or row[0] <= max(spec.chunk_rows // 4, 1):
            return width
    return BUCKET_WIDTHS[-1]


def time_bucket(ts: str | Column, seconds: float) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(float(seconds) * 1e6))


def attach(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str] | str,
    rows: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Left-join a statistics table on null-safe keys.

    ``rows`` is a proven bound on the table's size; only then is it broadcast. Without one the
    join strategy is left to adaptive execution.
    """
    on = as_list(on)
    right = table.select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[c for c in table.columns if c not in on],
    )
    if rows is not None and rows <= BROADCAST_ROWS:
        right = F.broadcast(right)
    cond = None
    for k in on:
        eq = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = eq if cond is None else cond & eq
    return df.join(right, cond, how).drop(*[f"__r_{k}" for k in on])


def scalars(df: DataFrame, *aggs: Column) -> dict[str, Column]:
    """One-row aggregates of ``df`` as columns usable in any frame (a scalar subquery)."""
    one = df.agg(*aggs)
    packed = one.select(F.struct(*one.columns)).scalar()
    return {c: packed.getField(c) for c in one.columns}


def row_scalars(one: DataFrame) -> dict[str, Column]:
    """The columns of a one-row frame as scalar subqueries."""
    packed = one.select(F.struct(*one.columns)).scalar()
    return {c: packed.getField(c) for c in one.columns}


@dataclass(frozen=True)
class Frames:
    """Rows prepared for ordered windows; call ``done`` on the result."""

    df: DataFrame
    keys: list[str]
    window: WindowSpec
    done: Callable[[DataFrame], DataFrame]

    def prev(self, n: int) -> WindowSpec:
        """The n rows before the current one."""
        return self.window.rowsBetween(-n, -1)


def row_frames(
    df: DataFrame, spec: PanelSpec, halo: int, keys: Sequence[str] | None = None
) -> Frames:
    """Windows over (keys, order by ts and id) that look back at most ``halo`` rows."""
    keys = [spec.entity] if keys is None else list(keys)
    if spec.bounded(keys):
        return Frames(df, keys, W.partitionBy(*keys).orderBy(*spec.order), lambda d: d)

    size = max(spec.chunk_rows, halo, 1)
    tagged = df.withColumn("__bucket", time_bucket(spec.ts, spec.bucket_seconds))
    counts = tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    long = attach(counts, totals.filter(F.col("__total") > size), keys, how="inner")
    layout = (
        past_sums(long, keys, "__bucket", {"__n": "__past"})
        .withColumn("__before", F.coalesce("__past", F.lit(0)))
        .select(
            *keys,
            "__bucket",
            F.floor(F.col("__before") / size).alias("__own"),
            F.least(
                F.floor((F.col("__before") + F.col("__n") + halo - 1) / size),
                F.floor((F.col("__total") - 1) / size),
            ).alias("__last"),
        )
    )
    zero = F.lit(0).cast("long")
    spread = (
        attach(tagged, layout, [*keys, "__bucket"])
        .withColumn("__own", F.coalesce("__own", zero))
        .withColumn(
            "__chunk", F.explode(F.sequence(F.col("__own"), F.coalesce("__last", zero)))
        )
        .drop("__last", "__bucket")
    )

    def done(out: DataFrame) -> DataFrame:
        return out.filter(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")

    part = [*keys, "__chunk"]
    return Frames(spread, part, W.partitionBy(*part).orderBy(*spec.order), done)


def past_sums(
    table: DataFrame, keys: Sequence[str], bucket: str, sums: Mapping[str, str]
) -> DataFrame:
    """Add the sums of all earlier buckets of the group to a table of (keys, bucket) totals.

    ``sums`` maps a total to the name of its running sum. Fine buckets over a long history are
    many, so they are carried in runs of SPAN buckets, and the runs in turn as a whole.
    """
    table = table.withColumn("__run", F.floor(F.col(bucket) / F.lit(SPAN)))
    earlier = W.partitionBy(*keys).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    runs = (
        table.groupBy(*keys, "__run")
        .agg(*[F.sum(c).alias(f"__r_{c}") for c in sums])
        .select(*keys, "__run", *[F.sum(f"__r_{c}").over(earlier).alias(f"__o_{c}") for c in sums])
    )
    inside = (
        W.partitionBy(*keys, "__run").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    )
    out = attach(table, runs, [*keys, "__run"]).withColumns(
        {f"__i_{c}": F.sum(c).over(inside) for c in sums}
    )
    both = {
        name: F.coalesce(
            F.col(f"__o_{c}") + F.col(f"__i_{c}"), F.col(f"__o_{c}"), F.col(f"__i_{c}")
        )
        for c, name in sums.items()
    }
    return out.withColumns(both).drop("__run", *[f"__o_{c}" for c in sums], *[f"__i_{c}" for c in sums])


def running(
    df: DataFrame, spec: PanelSpec, keys: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Add past-only running sums (rows strictly before the current one) per group of ``keys``.

    Each entry of ``sums`` is a per-row term; NULL terms are skipped and an empty past is NULL.
    """
    keys = list(keys)
    if spec.bounded(keys):
        past = W.partitionBy(*keys).orderBy(*spec.order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({name: F.sum(term).over(past) for name, term in sums.items()})

    tagged = df.withColumn("__bucket", time_bucket(spec.ts, spec.bucket_seconds))
    totals = tagged.groupBy(*keys, "__bucket").agg(
        *[F.sum(term).alias(f"__t_{name}") for name, term in sums.items()]
    )
    carried = past_sums(
        totals, keys, "__bucket", {f"__t_{name}": f"__c_{name}" for name in sums}
    ).drop(*[f"__t_{name}" for name in sums])
    inside = (
        W.partitionBy(*keys, "__bucket").orderBy(*spec.order).rowsBetween(W.unboundedPreceding, -1)
    )
    out = attach(tagged, carried, [*keys, "__bucket"]).withColumns(
        {f"__w_{name}": F.sum(term).over(inside) for name, term in sums.items()}
    )
    total = {
        name: F.coalesce(
            F.col(f"__c_{name}") + F.col(f"__w_{name}"), F.col(f"__c_{name}"), F.col(f"__w_{name}")
        )
        for name in sums
    }
    return out.withColumns(total).drop(
        "__bucket", *[f"__c_{n}" for n in sums], *[f"__w_{n}" for n in sums]
    )
