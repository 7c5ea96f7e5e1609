"""Registry of queries and their SQL counterparts.

A ``Shape`` names the output columns once and applies the same rounding and casts to both
sides: doubles are rounded after a tiny shift (so that sums taken in another order do not land
on the other side of a tie), whole numbers become BIGINT."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Shape:
    keys: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    dbls: tuple[str, ...] = ()
    digits: int = 6

    @property
    def shift(self) -> float:
        return 1e-9 if self.digits >= 5 else 1e-6

    def spark(self, df: DataFrame) -> DataFrame:
        return df.select(
            *self.keys,
            *[F.col(c).cast("long").alias(c) for c in self.ints],
            *[
                (F.round(F.col(c).cast("double") + F.lit(self.shift), self.digits) + F.lit(0.0)).alias(c)
                for c in self.dbls
            ],
        )

    def sql(self, body: str) -> str:
        cols = [
            *[f'"{c}"' for c in self.keys],
            *[f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.ints],
            *[
                f'round(CAST("{c}" AS DOUBLE) + {self.shift!r}, {self.digits}) + 0.0 AS "{c}"'
                for c in self.dbls
            ],
        ]
        # A body starting with WITH cannot be nested after another CTE list, so wrap it whole.
        return f"SELECT {', '.join(cols)} FROM (\n{body.strip()}\n) AS shaped"


def shape(keys: str = "", ints: str = "", dbls: str = "", digits: int = 6) -> Shape:
    return Shape(tuple(keys.split()), tuple(ints.split()), tuple(dbls.split()), digits)


def register(name: str, form: Shape, query: Query, sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: form.spark(query(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = form.sql(sql)


HOURLY = """panel AS (
  SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS ts, min(event_id) AS id,
    round(avg(value) + 1e-9, 6) AS target,
    round(sum(value) + 1e-9, 6) AS load_forecast,
    round(sum(value) FILTER (user_id % 2 = 0) + 1e-9, 6) AS wind_forecast,
    round(sum(value) FILTER (user_id % 3 = 0) + 1e-9, 6) AS solar_forecast,
    max(value) AS w1,
    min(value) FILTER (user_id % 5 = 0) AS w2
  FROM events GROUP BY 1, 2)"""

DAILY = """panel AS (
  SELECT o_orderpriority AS entity, o_orderdate AS ts, min(o_orderkey) AS id,
    round(avg(o_totalprice) + 1e-6, 3) AS target,
    round(sum(o_totalprice) + 1e-6, 3) AS load_forecast,
    round(sum(o_totalprice) FILTER (o_orderstatus = 'F') + 1e-6, 3) AS wind_forecast,
    round(sum(o_totalprice) FILTER (o_orderstatus = 'O') + 1e-6, 3) AS solar_forecast
  FROM orders GROUP BY 1, 2)"""

PREDS = """pe AS (
  SELECT event_id AS id, event_type AS entity, ts, value AS target,
    0.8::DOUBLE * value + 0.01::DOUBLE * user_id AS p1,
    value - 0.05::DOUBLE * user_id AS p2,
    5.0::DOUBLE + event_id % 17 AS p3,
    CASE WHEN user_id % 7 <> 0 THEN user_id::DOUBLE END AS w1,
    (1 + (day(ts) - 1) // 6)::INT AS fold,
    hour(ts) AS hour, isodow(ts) - 1 AS dow
  FROM events)"""

# The hourly panel with calendar columns and the residual load.
HOURLY_CAL = HOURLY + """, cal AS (
  SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month,
    load_forecast - wind_forecast - solar_forecast AS residual_load
  FROM panel)"""
