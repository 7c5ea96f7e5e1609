"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.sources.io import materialize

#: A word is a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether the row is held out. Rows without an id are, so nothing is learnt from them."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)
    return F.coalesce(rest == fold, F.lit(True))


def slices(batch, rows: int = 256) -> Iterator:
    """An Arrow batch or array in slices, so that few texts are Python strings at a time; memory
    that Arrow holds unused goes back when the last one is done."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def few_smallest(rows: DataFrame, place: str, n: int) -> DataFrame:
    """Rows that hold the ``n`` with the smallest ``place``, a 64-bit hash, and hardly more, so that a later
    top-n moves few rows. A cut that should leave a little over ``n`` is counted first; should it leave
    fewer (hashes that repeat), all rows come back."""
    total = rows.count()
    share = (n + 8 * n**0.5 + 64) / max(total, 1)
    if share >= 1:
        return rows
    some = rows.filter(F.col(place) <= int(share * 2**64) - 2**63)
    return some if some.count() >= n else rows


def add_running_start(df: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """Add the sum of ``amount`` over all earlier rows of a total order, without one sorted task.

    Rows are dealt out by range (full ties too, by a running number), summed per range, and the
    small table of range totals gives each range its offset. Columns ``_range`` and ``_tie`` are
    used inside."""
    n = parts(df.sparkSession)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    dealt = materialize(
        tied.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    )
    totals = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    # one row per range: as many as shuffle partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_range", "_off", "_sum", "_tie")
    )
