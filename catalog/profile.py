"""Queries for fitted statistics. Training rows are those before 2024-01-21 where a split is
needed; statistics are applied to the whole panel."""

from pyspark.sql import functions as F

from catalog.common import HOURLY_CAL, register, shape
from catalog.scalar import MET, met
from catalog.window import TRANSITION_SQL, EXPANDING_SQL, W, hourly, rank_sql
from panelkit.functions import scalar as S
from panelkit.functions.contract import wall_clock
from panelkit.operators import profile as P
from panelkit.operators import window as Wn
from panelkit.plans.panels import SPEC
from panelkit.sources.io import materialize

CUT = "2024-01-21"
TRAIN = HOURLY_CAL + f", train AS (SELECT * FROM cal WHERE ts < TIMESTAMP '{CUT}')"


def split(df):
    return df.filter(F.col("ts") < wall_clock(CUT))


def q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p}::DOUBLE)"


LEVELS = {"mhd": "entity, hour, dow", "mh": "entity, hour", "m": "entity"}
PROFILES = ", ".join(
    f"p_{k} AS (SELECT {keys}, avg(target) AS profile_{k}_mean, stddev_samp(target) AS profile_{k}_std, "
    f"count(target) AS profile_{k}_count FROM train GROUP BY {keys})"
    for k, keys in LEVELS.items()
)
JOINED = (
    "FROM cal LEFT JOIN p_mhd USING (entity, hour, dow) LEFT JOIN p_mh USING (entity, hour) "
    "LEFT JOIN p_m USING (entity)"
)


def _profiles(s, d):
    df, spec = hourly(s, d)
    return P.profiles(split(df), df, spec)


register(
    "E1_profiles",
    shape(
        "entity ts",
        "profile_mhd_count profile_mh_count profile_m_count",
        "profile_mhd_mean profile_mhd_std profile_mh_mean profile_mh_std profile_m_mean profile_m_std",
        5,
    ),
    _profiles,
    f"WITH {TRAIN}, {PROFILES} SELECT * {JOINED}",
)


def _winsor(s, d):
    df, spec = hourly(s, d)
    return P.winsorize(df, P.winsor_bounds(split(df), spec, 0.05, 0.9, 20), spec, "target", "clipped")


WINSOR = f"""cell AS (SELECT entity, hour, {q("target", 0.05)} AS lo, {q("target", 0.9)} AS hi
      FROM train GROUP BY ALL HAVING count(*) >= 20),
    ent AS (SELECT entity, {q("target", 0.05)} AS elo, {q("target", 0.9)} AS ehi FROM train GROUP BY ALL),
    glo AS (SELECT {q("target", 0.05)} AS glo, {q("target", 0.9)} AS ghi FROM train),
    bounds AS (SELECT cal.*, coalesce(lo, elo, glo) AS low, coalesce(hi, ehi, ghi) AS high
      FROM cal LEFT JOIN cell USING (entity, hour) LEFT JOIN ent USING (entity), glo)"""
register(
    "E2_winsorize",
    shape("entity ts", "", "target clipped"),
    _winsor,
    f"""WITH {TRAIN}, {WINSOR} SELECT entity, ts, target,
      least(greatest(target, low), greatest(high, low)) AS clipped FROM bounds""",
)


def _sparse_train(df):
    """Training rows that leave whole cells and one entity unseen."""
    return split(df).filter((F.col("entity") != "view") & ((F.col("hour") > 5) | (F.col("dow") > 4)))


SPARSE = (
    HOURLY_CAL
    + f""", train AS (SELECT * FROM cal WHERE ts < TIMESTAMP '{CUT}' AND entity <> 'view'
      AND (hour > 5 OR dow > 4)), {PROFILES},
    glo AS (SELECT avg(target) AS gm, coalesce(stddev_samp(target), 0) AS gs FROM train),
    m0 AS (SELECT * {JOINED}, glo),
    filled AS (SELECT * REPLACE (
        coalesce(profile_mhd_mean, profile_mh_mean, profile_m_mean, gm) AS profile_mhd_mean,
        coalesce(profile_mhd_std, profile_mh_std, profile_m_std, gs) AS profile_mhd_std,
        coalesce(profile_mh_mean, profile_m_mean, gm) AS profile_mh_mean,
        coalesce(profile_mh_std, profile_m_std, gs) AS profile_mh_std,
        coalesce(profile_m_mean, gm) AS profile_m_mean, coalesce(profile_m_std, gs) AS profile_m_std,
        coalesce(profile_mhd_count, 0) AS profile_mhd_count, coalesce(profile_mh_count, 0) AS profile_mh_count,
        coalesce(profile_m_count, 0) AS profile_m_count) FROM m0)"""
)


def _backoff(s, d):
    df, spec = hourly(s, d)
    train = _sparse_train(df)
    return P.backoff(P.profiles(train, df, spec), P.overall_stats(train))


PROFILE_SHAPE = shape(
    "entity ts",
    "profile_mhd_count profile_mh_count profile_m_count",
    "profile_mhd_mean profile_mhd_std profile_mh_mean profile_mh_std profile_m_mean profile_m_std",
    5,
)
register("E3_backoff", PROFILE_SHAPE, _backoff, f"WITH {SPARSE} SELECT * FROM filled")

register(
    "E4_shrink",
    PROFILE_SHAPE,
    lambda s, d: P.shrink(_backoff(s, d), 24.0, 12.0),
    f"""WITH {SPARSE}, w AS (SELECT *, profile_mhd_count / (profile_mhd_count + 24.0::DOUBLE) AS wd,
        profile_mh_count / (profile_mh_count + 12.0::DOUBLE) AS wh FROM filled)
      SELECT * REPLACE (
        wd * profile_mhd_mean + (1 - wd) * profile_mh_mean AS profile_mhd_mean,
        greatest(0, wd * profile_mhd_std + (1 - wd) * profile_mh_std) AS profile_mhd_std,
        (1 - wh) * profile_m_mean + wh * profile_mh_mean AS profile_m_mean,
        greatest(0, (1 - wh) * profile_m_std + wh * profile_mh_std) AS profile_m_std) FROM w""",
)


def _dynamic(s, d):
    df, spec = hourly(s, d)
    train = split(df)
    test = df.filter(F.col("ts") >= wall_clock(CUT))
    past, full = P.dynamic_profile(train, test, ["entity", "hour"], "p", spec)
    return past.unionByName(full, allowMissingColumns=True)


register(
    "E5_dynamic_profile",
    shape("entity ts", "", "p_dyn_count p_dyn_mean p_dyn_sq_mean p_dyn_std p_dyn_rms", 4),
    _dynamic,
    f"""WITH {TRAIN}, x AS ({EXPANDING_SQL.format(keys="entity, hour").replace("FROM cal", "FROM train")}),
      agg AS (SELECT entity, hour, count(target)::DOUBLE AS n, avg(target) AS m, stddev_samp(target) AS sd,
        avg(target * target) AS sq FROM train GROUP BY ALL)
      SELECT entity, ts, p_dyn_count, p_dyn_mean, p_dyn_sq_mean,
        CASE WHEN p_dyn_mean IS NOT NULL THEN p_dyn_std END AS p_dyn_std, p_dyn_rms FROM x
      UNION ALL SELECT entity, ts, n, m, sq, sd, sqrt(sq) FROM cal LEFT JOIN agg USING (entity, hour)
      WHERE ts >= TIMESTAMP '{CUT}'""",
)


def _deviation(s, d):
    df, spec = hourly(s, d)
    return P.baseline_deviation(
        split(df), df, ["load_forecast", "w2"], ["entity", "hour", "dow"], spec
    )


register(
    "E6_baseline_deviation",
    shape(
        "entity ts",
        "",
        "load_forecast_mhd_mean load_forecast_mhd_std load_forecast_mhd_delta load_forecast_mhd_z "
        "w2_mhd_delta w2_mhd_z",
        4,
    ),
    _deviation,
    f"""WITH {TRAIN}, c AS (SELECT entity, hour, dow, avg(load_forecast) AS load_forecast_mhd_mean,
        stddev_samp(load_forecast) AS load_forecast_mhd_std, avg(w2) AS wm, stddev_samp(w2) AS ws
        FROM train GROUP BY ALL)
      SELECT *, load_forecast - load_forecast_mhd_mean AS load_forecast_mhd_delta,
        (load_forecast - load_forecast_mhd_mean) / (coalesce(load_forecast_mhd_std, 0) + 1e-3::DOUBLE) AS load_forecast_mhd_z,
        w2 - wm AS w2_mhd_delta, (w2 - wm) / (coalesce(ws, 0) + 1e-3::DOUBLE) AS w2_mhd_z
      FROM cal LEFT JOIN c USING (entity, hour, dow)""",
)


def _quantile_regimes(s, d):
    df, spec = hourly(s, d)
    return P.quantile_regimes(split(df), df, "residual_load", spec)


register(
    "E7_quantile_regimes",
    shape(
        "entity ts",
        "is_low_residual_load_regime is_high_residual_load_regime is_mid_high_residual_load",
        "residual_load_tail_up residual_load_tail_down",
    ),
    _quantile_regimes,
    f"""WITH {TRAIN}, t AS (SELECT entity, {q("residual_load", 0.1)} AS a, {q("residual_load", 0.9)} AS b,
        {q("residual_load", 0.75)} AS c FROM train GROUP BY entity)
      SELECT entity, ts, coalesce(residual_load <= a, false)::INT AS is_low_residual_load_regime,
        coalesce(residual_load >= b, false)::INT AS is_high_residual_load_regime,
        coalesce(residual_load >= c, false)::INT AS is_mid_high_residual_load,
        CASE WHEN residual_load IS NOT NULL THEN greatest(residual_load - b, 0) END AS residual_load_tail_up,
        CASE WHEN residual_load IS NOT NULL THEN greatest(a - residual_load, 0) END AS residual_load_tail_down
      FROM cal LEFT JOIN t USING (entity)""",
)


def _pctl(s, d):
    df, spec = hourly(s, d)
    return P.empirical_pctl(split(df), df, "residual_load", spec)


register(
    "E8_empirical_pctl",
    shape("entity ts", "is_high_residual", "residual_load_pctl"),
    _pctl,
    f"""WITH {TRAIN}, n AS (SELECT entity, count(residual_load) AS n FROM train GROUP BY 1),
      less AS (SELECT cal.id, count(t.id) FILTER (t.residual_load < cal.residual_load) AS lt,
          count(t.id) AS le FROM cal
        LEFT JOIN train t ON t.entity = cal.entity AND t.residual_load <= cal.residual_load GROUP BY 1),
      p AS (SELECT entity, ts, CASE WHEN residual_load IS NOT NULL THEN 0.5::DOUBLE * (lt + le) / greatest(n - 1, 1) END AS p
        FROM cal JOIN less USING (id) JOIN n USING (entity))
      SELECT entity, ts, p AS residual_load_pctl, coalesce(p >= 0.8::DOUBLE, false)::INT AS is_high_residual FROM p""",
)


def _bins(s, d):
    df, spec = hourly(s, d)
    return P.quantile_bins(split(df), df, "w2", 10, spec)


register(
    "E9_quantile_bins",
    shape("entity ts", "", "w2_bin10"),
    _bins,
    f"""WITH {TRAIN}, edges AS (SELECT DISTINCT entity, unnest(quantile_cont(w2, {[i / 10 for i in range(11)]})) AS e
        FROM train GROUP BY entity),
      span AS (SELECT entity, min(e) AS lo, max(e) AS hi FROM edges GROUP BY entity),
      b AS (SELECT cal.id, count(e) FILTER (e > lo AND e < hi AND e < w2) AS b
        FROM cal LEFT JOIN span USING (entity) LEFT JOIN edges USING (entity) GROUP BY 1)
      SELECT entity, ts, CASE WHEN w2 BETWEEN lo AND hi AND lo < hi THEN b END AS w2_bin10
      FROM cal JOIN b USING (id) JOIN span USING (entity)""",
)


def _standardize(s, d):
    df, spec = hourly(s, d)
    return P.standardize(split(df), df, "residual_load", spec)


register(
    "E10_standardize",
    shape("entity ts", "", "residual_load_z"),
    _standardize,
    f"""WITH {TRAIN}, t AS (SELECT entity, avg(residual_load) AS m, stddev_pop(residual_load) AS s
        FROM train GROUP BY 1)
      SELECT entity, ts, (residual_load - m) / CASE WHEN s > 1e-9 THEN s ELSE 1 END AS residual_load_z
      FROM cal LEFT JOIN t USING (entity)""",
)


def _stress(s, d):
    df, spec = hourly(s, d)
    df = Wn.lags(df, spec, ["load_forecast"], [1])
    return P.stress_thresholds(split(df), df, spec)


register(
    "E11_stress_thresholds",
    shape(
        "entity ts",
        "",
        "excess_load_90 wind_deficit_10 stress_excess stress_excess_1819 load_diff_1 neg_load_ramp_1 "
        "stress_ramp_1819",
        4,
    ),
    _stress,
    f"""WITH {TRAIN}, t AS (SELECT entity, {q("load_forecast", 0.9)} AS l90, {q("wind_forecast", 0.1)} AS w10
        FROM train WHERE hour IN (18, 19) GROUP BY 1),
      f AS (SELECT *, greatest(load_forecast - l90, 0) AS excess_load_90,
        CASE WHEN wind_forecast IS NOT NULL THEN greatest(w10 - wind_forecast, 0) END AS wind_deficit_10,
        load_forecast - lag(load_forecast) OVER w AS load_diff_1, (hour IN (18, 19))::INT AS late
        FROM cal LEFT JOIN t USING (entity) {W}),
      g AS (SELECT *, CASE WHEN load_diff_1 IS NOT NULL THEN greatest(-load_diff_1, 0) END AS neg_load_ramp_1 FROM f)
      SELECT *, excess_load_90 * wind_deficit_10 AS stress_excess,
        excess_load_90 * wind_deficit_10 * late AS stress_excess_1819,
        late * wind_deficit_10 * neg_load_ramp_1 AS stress_ramp_1819 FROM g""",
)


def _state(s, d):
    df, spec = hourly(s, d, "ts")
    df = Wn.transition(S.system_state(df), spec)
    # The fit reads this table several times and the flags once more.
    return materialize(Wn.robust_cross(df, spec, ["residual_load", "solar_share"])), spec


REGIME_FRAME = (
    HOURLY_CAL
    + f""", st AS (SELECT *, wind_forecast / greatest(load_forecast, 1e-6::DOUBLE) AS wind_share,
      solar_forecast / greatest(load_forecast, 1e-6::DOUBLE) AS solar_share,
      load_forecast / (wind_forecast + 1000::DOUBLE) AS stress_ratio, {TRANSITION_SQL} FROM cal {W}),
    fr AS (SELECT *,
      CASE WHEN stddev_samp(residual_load) OVER (PARTITION BY ts) > 1e-3 THEN {rank_sql("residual_load")} ELSE 0.5 END AS rr,
      CASE WHEN stddev_samp(solar_share) OVER (PARTITION BY ts) > 1e-3 THEN {rank_sql("solar_share")} ELSE 0.5 END AS sr
      FROM st),
    tr AS (SELECT * FROM fr WHERE ts < TIMESTAMP '{CUT}'),"""
    + "thr AS (SELECT {keys} "
    + f"""{q("residual_load", 0.25)} FILTER (hour BETWEEN 10 AND 16) AS lowprice_residual,
      {q("solar_share", 0.75)} FILTER (hour BETWEEN 10 AND 16) AS lowprice_solar,
      {q("abs_residual_ramp_1", 0.85)} AS transition_ramp,
      {q("residual_load_roll_std_6", 0.85)} AS transition_std,
      {q("residual_load", 0.8)} FILTER (hour BETWEEN 17 AND 20) AS peak_residual,
      {q("wind_share", 0.2)} FILTER (hour BETWEEN 17 AND 20) AS peak_windshare,
      {q("stress_ratio", 0.8)} FILTER (hour BETWEEN 17 AND 20) AS peak_stress
      FROM tr {{group}})"""
)
_PER = REGIME_FRAME.format(keys="entity,", group="GROUP BY entity")
_GLOBAL = REGIME_FRAME.format(keys="", group="").split("thr AS ", 1)[1]
NAMES = list(P.REGIME_THRESHOLDS)
FITTED = (
    _PER
    + f", gthr AS {_GLOBAL}, "
    + "share AS (SELECT tr.entity, count(*) FILTER (hour BETWEEN 17 AND 20 "
    "AND residual_load >= coalesce(thr.peak_residual, gthr.peak_residual) "
    "AND wind_share <= coalesce(thr.peak_windshare, gthr.peak_windshare)) "
    "/ nullif(count(*) FILTER (hour BETWEEN 17 AND 20), 0) AS share "
    "FROM tr JOIN thr USING (entity), gthr GROUP BY 1), "
    "fitted AS (SELECT thr.*, "
    + ", ".join(f"gthr.{n} AS g_{n}" for n in NAMES)
    + ", coalesce(share > 0.1::DOUBLE, false) AS stress_filter FROM thr JOIN share USING (entity), gthr)"
)


def _fit_regimes(s, d):
    df, spec = _state(s, d)
    return P.fit_regimes(split(df), spec)


register(
    "E12_fit_regimes",
    shape("entity", "stress_filter", " ".join([*NAMES, *[f"g_{n}" for n in NAMES]])),
    _fit_regimes,
    f"WITH {FITTED} SELECT * FROM fitted",
)


def _apply_regimes(s, d):
    df, spec = _state(s, d)
    # One entity is left out of the fit and takes the global defaults.
    return P.apply_regimes(df, P.fit_regimes(split(df), spec).filter("entity <> 'view'"), spec)


APPLIED = (
    FITTED
    + """, g AS (SELECT """
    + ", ".join(f"max(g_{n}) AS {n}" for n in NAMES)
    + """ FROM fitted),
    flags AS (SELECT fr.*,
      hour BETWEEN 10 AND 16 AND (coalesce(residual_load <= coalesce(f.lowprice_residual, g.lowprice_residual)
          AND solar_share >= coalesce(f.lowprice_solar, g.lowprice_solar), false)
        OR coalesce(rr <= 0.25 AND sr >= 0.75, false)) AS lowprice_midday,
      coalesce(hour BETWEEN 17 AND 20 AND residual_load >= coalesce(f.peak_residual, g.peak_residual)
        AND wind_share <= coalesce(f.peak_windshare, g.peak_windshare)
        AND (NOT coalesce(f.stress_filter, false)
          OR stress_ratio >= coalesce(f.peak_stress, g.peak_stress)), false) AS peak_scarcity,
      coalesce(abs_residual_ramp_1 >= coalesce(f.transition_ramp, g.transition_ramp), false)
        OR coalesce(residual_load_roll_std_6 >= coalesce(f.transition_std, g.transition_std), false) AS transition
      FROM fr LEFT JOIN (SELECT * FROM fitted WHERE entity <> 'view') f USING (entity), g),
    regimes AS (SELECT *, NOT (lowprice_midday OR peak_scarcity OR transition) AS normal,
      CASE WHEN lowprice_midday THEN 'lowprice_midday' WHEN peak_scarcity THEN 'peak_scarcity'
        WHEN transition THEN 'transition' ELSE 'normal' END AS primary_regime FROM flags)"""
)
register(
    "E13_apply_regimes",
    shape("entity ts primary_regime", "lowprice_midday peak_scarcity transition normal"),
    _apply_regimes,
    f"WITH {APPLIED} SELECT * FROM regimes",
)


def _storm(s, d):
    df = met(s, d)
    spec = SPEC.measured(df)
    return P.storm(split(df), df, spec)


register(
    "E14_storm",
    shape("entity ts", "storm_flag", "storm_risk"),
    _storm,
    f"""WITH {MET}, t AS (SELECT * FROM met WHERE ts < TIMESTAMP '{CUT}'),
      lim AS (SELECT entity, {q("convective_inhibition", 0.2)} AS lim FROM t GROUP BY 1),
      g AS (SELECT {q("convective_inhibition", 0.2)} AS g FROM t),
      r AS (SELECT entity, ts, ln(1 + greatest(convective_available_potential_energy, 0))
        * coalesce(convective_inhibition <= coalesce(lim, g), false)::INT AS storm_risk
        FROM met LEFT JOIN lim USING (entity), g),
      h AS (SELECT {q("storm_risk", 0.9)} AS h FROM r WHERE ts < TIMESTAMP '{CUT}')
      SELECT entity, ts, storm_risk, (storm_risk > h)::INT AS storm_flag FROM r, h""",
)


def _impute(s, d):
    df, spec = hourly(s, d)
    df = df.withColumn("tag", F.when(F.col("w2").isNotNull(), F.concat(F.lit("t"), "hour")))
    return P.impute(split(df).filter("entity <> 'view'"), df, ["wind_forecast", "w2"], ["tag"], spec)


register(
    "E15_impute",
    shape("entity ts tag", "", "wind_forecast w2"),
    _impute,
    f"""WITH {HOURLY_CAL}, train AS (SELECT * FROM cal WHERE ts < TIMESTAMP '{CUT}' AND entity <> 'view'),
      m AS (SELECT entity, median(wind_forecast) AS a, median(w2) AS b FROM train GROUP BY 1),
      g AS (SELECT median(coalesce(wind_forecast, a)) AS ga, median(coalesce(w2, b)) AS gb
        FROM train JOIN m USING (entity))
      SELECT entity, ts, CASE WHEN w2 IS NOT NULL THEN 't' || hour ELSE 'missing' END AS tag,
        coalesce(wind_forecast, a, ga) AS wind_forecast, coalesce(w2, b, gb) AS w2
      FROM cal LEFT JOIN m USING (entity), g""",
)


def _coverage(s, d):
    df, spec = hourly(s, d)
    doubled = df.unionByName(df.filter("hour = 3"))
    return P.coverage(doubled, spec, ["wind_forecast", "w2"])


register(
    "E16_coverage",
    shape(
        "entity min_ts max_ts",
        "rows duplicates",
        "target_mean target_std null_share_wind_forecast null_share_w2",
    ),
    _coverage,
    f"""WITH {HOURLY_CAL}, x AS (SELECT * FROM cal UNION ALL SELECT * FROM cal WHERE hour = 3)
      SELECT entity, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS rows,
        count(*) - count(DISTINCT ts) AS duplicates, avg(target) AS target_mean,
        stddev_samp(target) AS target_std, avg((wind_forecast IS NULL)::INT) AS null_share_wind_forecast,
        avg((w2 IS NULL)::INT) AS null_share_w2 FROM x GROUP BY 1""",
)
