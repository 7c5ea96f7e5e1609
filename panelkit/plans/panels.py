"""Panels derived from the driver's tables, one row per (entity, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.plans.layout import PanelSpec

SPEC = PanelSpec()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _six(c) -> F.Column:
    return F.round(c, 6)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour."""
    v, u = F.col("value"), F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("entity"),
            F.timestamp_add("HOUR", F.hour("ts"), F.to_date("ts").cast("timestamp_ntz")).alias("ts"),
        )
        .agg(
            F.min("event_id").alias("id"),
            _six(F.avg(v) + 1e-9).alias("target"),
            _six(F.sum(v) + 1e-9).alias("load_forecast"),
            _six(F.sum(F.when(u % 2 == 0, v)) + 1e-9).alias("wind_forecast"),
            _six(F.sum(F.when(u % 3 == 0, v)) + 1e-9).alias("solar_forecast"),
            F.max(v).alias("w1"),
            F.min(F.when(u % 5 == 0, v)).alias("w2"),
        )
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and day."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("entity"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        )
        .agg(
            F.min("o_orderkey").alias("id"),
            F.round(F.avg(p) + 1e-6, 3).alias("target"),
            F.round(F.sum(p) + 1e-6, 3).alias("load_forecast"),
            F.round(F.sum(F.when(s == "F", p)) + 1e-6, 3).alias("wind_forecast"),
            F.round(F.sum(F.when(s == "O", p)) + 1e-6, 3).alias("solar_forecast"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, with three prediction columns and a weather stand-in."""
    v, u, i = F.col("value"), F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.col("event_type").alias("entity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        v.alias("target"),
        (0.8 * v + 0.01 * u).alias("p1"),
        (v - 0.05 * u).alias("p2"),
        (F.lit(5.0) + i % 17).alias("p3"),
        F.when(u % 7 != 0, u.cast("double")).alias("w1"),
        (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int").alias("fold"),
    )
