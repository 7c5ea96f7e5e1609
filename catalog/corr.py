"""Queries for correlation analytics."""

from pyspark.sql import functions as F

from catalog.common import HOURLY_CAL, PREDS, register, shape
from catalog.metrics import preds
from catalog.window import EVENT_TYPES, WIDE, daily, hourly, DAILY_RES
from panelkit.operators import corr as K

PAIRS = WIDE.format(cond="a.entity < b.entity")


def corr(x: str, y: str) -> str:
    """Correlation that is NULL on a constant side."""
    return f"""CASE WHEN stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) > 0
      AND stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) > 0 THEN corr({x}, {y}) END"""


def _wide(s, d):
    df, spec = hourly(s, d)
    return K.wide_panel(df, spec, EVENT_TYPES)


register(
    "K1_wide_panel",
    shape("ts", "", " ".join(EVENT_TYPES)),
    _wide,
    f"WITH {HOURLY_CAL} SELECT ts, "
    + ", ".join(f"avg(target) FILTER (entity = '{e}') AS \"{e}\"" for e in EVENT_TYPES)
    + " FROM cal GROUP BY ts",
)


def _pearson(s, d):
    df, spec = hourly(s, d)
    return K.corr_matrix(df, spec, EVENT_TYPES)


register(
    "K2_corr_pearson",
    shape("a b", "n", "corr"),
    _pearson,
    f"""WITH {HOURLY_CAL}, {PAIRS} SELECT a, b, count(x) AS n, {corr("x", "y")} AS corr FROM full_pairs GROUP BY a, b""",
)


def _spearman(s, d):
    df, spec = hourly(s, d)
    return K.corr_matrix(df, spec, EVENT_TYPES, "spearman")


register(
    "K2_corr_spearman",
    shape("a b", "n", "corr"),
    _spearman,
    f"""WITH {HOURLY_CAL}, {PAIRS}, r AS (SELECT a, b,
        rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry
        FROM full_pairs WHERE x IS NOT NULL)
      SELECT a, b, count(*) AS n, corr(rx, ry) AS corr FROM r GROUP BY a, b""",
)

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _monthly(s, d):
    df, spec = daily(s, d)
    out = K.corr_by(df, spec, PRIORITIES, "month", min_rows=3)
    return out.withColumn("month", F.col("month").cast("timestamp_ntz"))


register(
    "K3_corr_by_month",
    shape("month a b", "n", "corr"),
    _monthly,
    f"""WITH {DAILY_RES}, {PAIRS} SELECT date_trunc('month', ts)::TIMESTAMP AS month, a, b, count(x) AS n,
      CASE WHEN count(x) >= 3 THEN {corr("x", "y")} END AS corr FROM full_pairs GROUP BY ALL""",
)


def _by_hour(s, d):
    df, spec = hourly(s, d)
    hour = K.corr_by(df, spec, EVENT_TYPES, "hour").withColumnRenamed("hour", "part")
    dow = K.corr_by(df, spec, EVENT_TYPES, "dow").withColumnRenamed("dow", "part")
    return hour.withColumn("grain", F.lit("hour")).unionByName(dow.withColumn("grain", F.lit("dow")))


register(
    "K3_corr_by_hour_dow",
    shape("grain a b", "part n", "corr"),
    _by_hour,
    f"""WITH {HOURLY_CAL}, {PAIRS}
      SELECT 'hour' AS grain, hour(ts) AS part, a, b, count(x) AS n, {corr("x", "y")} AS corr FROM full_pairs GROUP BY ALL
      UNION ALL SELECT 'dow', isodow(ts) - 1 AS part, a, b, count(x), {corr("x", "y")} FROM full_pairs GROUP BY ALL""",
)

LAGS = tuple(range(-24, 25))


def _lead_lag(s, d):
    df, spec = hourly(s, d)
    return K.lead_lag(df, spec, EVENT_TYPES, "click", LAGS)


LEAD_SQL = f"""{HOURLY_CAL}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts FROM panel)),
  v AS (SELECT entity, p, target FROM panel JOIN t USING (ts)),
  ll AS (SELECT 'click' AS a, o.entity AS b, k AS lag, {corr("c.target", "o.target")} AS corr
    FROM v c, range(-24, 25) AS r(k), v o WHERE c.entity = 'click' AND o.entity <> 'click' AND o.p = c.p - k
    GROUP BY ALL)"""
register(
    "K4_lead_lag", shape("a b", "lag", "corr"), _lead_lag, f"WITH {LEAD_SQL} SELECT * FROM ll"
)
register(
    "K4_best_lag",
    shape("a b", "lag", "corr abs_corr"),
    lambda s, d: K.best_lag(_lead_lag(s, d)),
    f"""WITH {LEAD_SQL} SELECT a, b, lag, corr, abs(corr) AS abs_corr FROM (SELECT *, row_number() OVER (
      PARTITION BY a, b ORDER BY abs(corr) DESC, lag) AS r FROM ll) WHERE r = 1""",
)

FEATURES = ["load_forecast", "wind_forecast", "w1", "w2"]
FEATURE_SQL = f"""{HOURLY_CAL}, f AS (SELECT * FROM (SELECT ts, entity, target, load_forecast, wind_forecast, w1, w2 FROM cal)
    UNPIVOT INCLUDE NULLS (v FOR feature IN (load_forecast, wind_forecast, w1, w2)))"""


def _coupling(s, d):
    df, spec = hourly(s, d)
    return K.coupling_strength(df, spec, EVENT_TYPES, FEATURES)


register(
    "K5_coupling_strength",
    shape("feature", "", "mean_corr mean_abs_corr std_corr min_corr max_corr"),
    _coupling,
    f"""WITH {FEATURE_SQL}, c AS (SELECT p.feature, p.entity AS a, q.entity AS b, {corr("p.v", "q.v")} AS corr
        FROM f p JOIN f q ON p.feature = q.feature AND p.ts = q.ts AND p.entity < q.entity GROUP BY ALL)
      SELECT feature, avg(corr) AS mean_corr, avg(abs(corr)) AS mean_abs_corr, stddev_samp(corr) AS std_corr,
        min(corr) AS min_corr, max(corr) AS max_corr FROM c GROUP BY feature""",
)


def _map(s, d):
    df, spec = hourly(s, d)
    return K.feature_target_map(df, spec, EVENT_TYPES, FEATURES)


MAP_SQL = f"""{FEATURE_SQL}, m AS (SELECT p.feature, p.entity AS a, q.entity AS b,
    count(p.v) AS n, {corr("p.v", "q.target")} AS corr
    FROM f p JOIN cal q ON p.ts = q.ts GROUP BY ALL)"""
register(
    "K6_feature_target_map",
    shape("feature a b", "n", "corr"),
    _map,
    f"WITH {MAP_SQL} SELECT * FROM m",
)
register(
    "K6_same_and_cross",
    shape("feature", "", "mean_same mean_cross"),
    lambda s, d: K.same_and_cross(_map(s, d)),
    f"""WITH {MAP_SQL} SELECT feature, avg(corr) FILTER (a = b) AS mean_same,
      avg(corr) FILTER (a <> b) AS mean_cross FROM m GROUP BY 1""",
)

RUNS = ("p1", "p2", "p3")


def _runs(s, d):
    df, _ = preds(s, d)
    return df.select(
        "id",
        "hour",
        F.explode(F.array(*[F.struct(F.lit(p).alias("run"), F.col(p).alias("pred")) for p in RUNS])).alias("x"),
    ).select("id", "hour", "x.*")


def _similarity(s, d):
    long = _runs(s, d)
    total = K.prediction_similarity(long, RUNS).withColumn("hour", F.lit(None).cast("int"))
    return K.prediction_similarity(long, RUNS, "hour").unionByName(total)


def _run_pairs(hour: str, group: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {hour} AS hour, '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS corr FROM pe {group}"
        for a, b in (("p1", "p2"), ("p1", "p3"), ("p2", "p3"))
    )


register(
    "K7_prediction_similarity",
    shape("a b", "n", "hour corr"),
    _similarity,
    f"WITH {PREDS} {_run_pairs('hour', 'GROUP BY hour')} UNION ALL {_run_pairs('NULL', '')}",
)
register(
    "K7_lowest_pairs",
    shape("a b", "n", "corr"),
    lambda s, d: K.lowest_pairs(K.prediction_similarity(_runs(s, d), RUNS), 2),
    f"WITH {PREDS}, r AS ({_run_pairs('NULL', '')}) SELECT a, b, n, corr FROM r ORDER BY corr LIMIT 2",
)
register(
    "K7_against_reference",
    shape("run", "n", "hour corr"),
    lambda s, d: K.against(K.prediction_similarity(_runs(s, d), RUNS, "hour"), "p2"),
    f"""WITH {PREDS} SELECT hour, 'p1' AS run, count(*) AS n, corr(p2, p1) AS corr FROM pe GROUP BY hour
      UNION ALL SELECT hour, 'p3', count(*), corr(p2, p3) FROM pe GROUP BY hour""",
)
