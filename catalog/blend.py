"""Queries for calibration, caps and blends. Folds 1-3 of the event table are the training part."""

from pyspark.sql import functions as F

from catalog.common import PREDS, register, shape
from catalog.metrics import preds
from catalog.profile import APPLIED, _apply_regimes
from panelkit.operators import blend as I
from panelkit.plans.panels import SPEC

OUT = shape("id", "", "target")


def three(df):
    return {p: df.select("id", F.col(p).alias("target")) for p in ("p1", "p2", "p3")}


def _average(s, d):
    df, _ = preds(s, d)
    return I.weighted_average(three(df), [2.0, 1.0, 1.0])


register(
    "I1_weighted_average",
    OUT,
    _average,
    f"WITH {PREDS} SELECT id, 0.5::DOUBLE * p1 + 0.25::DOUBLE * p2 + 0.25::DOUBLE * p3 AS target FROM pe",
)


def _long(df):
    return df.select(
        "id",
        "fold",
        "target",
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("pred")) for p in ("p1", "p2", "p3")])
        ).alias("x"),
    ).select("id", "fold", "target", "x.*")


LONG = "l AS (UNPIVOT (SELECT id, fold, target, p1, p2, p3 FROM pe) ON p1, p2, p3 INTO NAME name VALUE pred)"


def _weights(s, d):
    df, _ = preds(s, d)
    err = F.col("pred") - F.col("target")
    return I.inverse_error_weights(
        _long(df).groupBy("name").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    )


register(
    "I2_inverse_error_weights",
    shape("name", "", "weight"),
    _weights,
    f"""WITH {PREDS}, {LONG}, m AS (SELECT name, 1 / avg((pred - target) * (pred - target)) AS w FROM l GROUP BY 1)
      SELECT name, w / sum(w) OVER () AS weight FROM m""",
)


def _fold_blend(s, d):
    df, _ = preds(s, d)
    long = _long(df)
    err = F.col("pred") - F.col("target")
    metrics = long.groupBy("name", "fold").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    w = I.fold_weights(metrics).select("name", "fold", "weight")
    return I.fold_weighted_blend(long.join(w, ["name", "fold"]))


register(
    "I3_fold_weighted_blend",
    OUT,
    _fold_blend,
    f"""WITH {PREDS}, {LONG}, m AS (SELECT name, fold,
        1 / (sqrt(avg((pred - target) * (pred - target))) + 1e-6::DOUBLE) AS w FROM l GROUP BY ALL)
      SELECT id, sum(pred * w) / sum(w) AS target FROM l JOIN m USING (name, fold) GROUP BY id""",
)


def _part(df):
    """Training rows without one entity and without early hours, so that lookups back off."""
    return df.filter("fold <= 3 AND entity <> 'view' AND hour > 4")


PART = "tr AS (SELECT * FROM pe WHERE fold <= 3 AND entity <> 'view' AND hour > 4)"


def bounds_sql(lo: float, hi: float, min_rows: int = 0) -> str:
    q = f"quantile_cont(target, {lo}::DOUBLE) AS {{0}}l, quantile_cont(target, {hi}::DOUBLE) AS {{0}}h"
    return f"""c AS (SELECT entity, hour, {q.format("c")}, stddev_samp(target) AS cs FROM tr GROUP BY ALL
        HAVING count(*) >= {min_rows}),
      e AS (SELECT entity, {q.format("e")}, stddev_samp(target) AS es FROM tr GROUP BY ALL),
      g AS (SELECT {q.format("g")}, stddev_samp(target) AS gs FROM tr),
      b AS (SELECT pe.*, coalesce(cl, el, gl) AS lo, coalesce(ch, eh, gh) AS hi,
          coalesce(coalesce(cs, CASE WHEN cl IS NOT NULL THEN 0 END), es, gs) AS sd, gs
        FROM pe LEFT JOIN c USING (entity, hour) LEFT JOIN e USING (entity), g)"""


def _guardrail(s, d):
    df, spec = preds(s, d)
    return I.guardrail_apply(df, I.guardrail_fit(_part(df), spec, 0.05, 0.9), spec, "p1")


register(
    "I4_guardrail",
    shape("id", "was_clipped", "p1"),
    _guardrail,
    f"""WITH {PREDS}, {PART}, {bounds_sql(0.05, 0.9)}
      SELECT id, least(greatest(p1, lo), hi) AS p1, (p1 < lo OR p1 > hi)::INT AS was_clipped FROM b""",
)


def _soft_cap(s, d):
    df, spec = preds(s, d)
    over = {"click": {"lower_q": 0.2, "upper_q": 0.7}, "error": {"min_rows": 40}}
    caps = I.soft_cap_fit(_part(df), spec, 0.05, 0.9, 10, over)
    return I.soft_cap_apply(df, caps, spec, "p1", 0.25)


def _cap_q(q: float, own: float) -> str:
    return (
        f"CASE WHEN entity = 'click' THEN quantile_cont(target, {own}::DOUBLE) "
        f"ELSE quantile_cont(target, {q}::DOUBLE) END"
    )


register(
    "I5_soft_cap",
    shape("id", "was_capped", "p1"),
    _soft_cap,
    f"""WITH {PREDS}, {PART},
      c AS (SELECT entity, hour, {_cap_q(0.05, 0.2)} AS cl, {_cap_q(0.9, 0.7)} AS ch FROM tr GROUP BY entity, hour
        HAVING count(*) >= CASE WHEN entity = 'error' THEN 40 ELSE 10 END),
      e AS (SELECT entity, {_cap_q(0.05, 0.2)} AS el, {_cap_q(0.9, 0.7)} AS eh FROM tr GROUP BY entity),
      g AS (SELECT quantile_cont(target, 0.05::DOUBLE) AS gl, quantile_cont(target, 0.9::DOUBLE) AS gh FROM tr),
      b AS (SELECT pe.*, coalesce(cl, el, gl) AS lo, coalesce(ch, eh, gh) AS hi
        FROM pe LEFT JOIN c USING (entity, hour) LEFT JOIN e USING (entity), g)
      SELECT id, CASE WHEN p1 > hi THEN hi + 0.25 * (p1 - hi) WHEN p1 < lo THEN lo + 0.25 * (p1 - lo) ELSE p1 END AS p1,
        (p1 < lo OR p1 > hi)::INT AS was_capped FROM b""",
)


def _peak_bias(s, d):
    df, spec = preds(s, d)
    df = df.withColumn("pred", F.col("p1"))
    return I.peak_bias_apply(df, I.peak_bias_fit(_part(df), spec, [17, 18, 19, 20], 45), spec)


register(
    "I6_peak_bias",
    shape("id", "", "pred"),
    _peak_bias,
    f"""WITH {PREDS}, {PART}, b AS (SELECT entity, hour, avg(target - p1) AS bias FROM tr
        WHERE hour BETWEEN 17 AND 20 GROUP BY ALL HAVING count(*) >= 45)
      SELECT id, p1 + coalesce(bias, 0) AS pred FROM pe LEFT JOIN b USING (entity, hour)""",
)


def _cell_table(s, d):
    df, spec = preds(s, d)
    df = df.withColumn("pred", F.col("p1"))
    return I.cell_bias_calibration(
        df, spec, [17, 18, 19], ("click", [0, 1, 2, 3]), 0.6, 60, 4.0
    ), df, spec


CELL_SQL = f"""{PREDS}, cells AS (SELECT entity, hour, count(*) AS rows, avg(p1 - target) AS bias,
    sqrt(avg((p1 - target) * (p1 - target))) AS rmse FROM pe
    WHERE hour IN (17, 18, 19) OR (entity = 'click' AND hour <= 3) GROUP BY ALL HAVING count(*) >= 60),
  cal AS (SELECT *, -0.6::DOUBLE * bias AS raw_adjustment,
    least(greatest(-0.6::DOUBLE * bias, -4), 4) AS adjustment,
    (hour IN (17, 18, 19))::INT AS is_general_rule, (entity = 'click' AND hour <= 3)::INT AS is_extra_rule
    FROM cells)"""
register(
    "I7_cell_bias_table",
    shape(
        "entity", "hour rows is_general_rule is_extra_rule", "bias rmse raw_adjustment adjustment"
    ),
    lambda s, d: _cell_table(s, d)[0],
    f"WITH {CELL_SQL} SELECT * FROM cal",
)


def _cell_apply(s, d):
    table, df, spec = _cell_table(s, d)
    return I.cell_bias_apply(df, table, spec)


register(
    "I7_cell_bias_apply",
    shape("id", "", "pred"),
    _cell_apply,
    f"WITH {CELL_SQL} SELECT id, p1 + coalesce(adjustment, 0) AS pred FROM pe LEFT JOIN cal USING (entity, hour)",
)


def _residual(s, d):
    df, spec = preds(s, d)
    df = df.withColumn("pred", F.col("p2"))
    return I.residual_correct(df, I.residual_correction(_part(df), spec, 0.4), spec)


register(
    "I8_residual_correction",
    shape("id", "", "pred"),
    _residual,
    f"""WITH {PREDS}, {PART}, r AS (SELECT entity, hour, dow, 0.4::DOUBLE * avg(target - p2) AS r FROM tr GROUP BY ALL)
      SELECT id, p2 + coalesce(r, 0) AS pred FROM pe LEFT JOIN r USING (entity, hour, dow)""",
)

REGIME_WEIGHTS = {"peak_scarcity": 0.9, "transition": 0.7, "normal": 0.2, "lowprice_midday": 1.4}


def _regime_blend(s, d):
    df = _apply_regimes(s, d)
    return I.regime_blend(df, "target", "w1", REGIME_WEIGHTS, SPEC, "click")


register(
    "I9_regime_blend",
    shape("entity ts primary_regime", "", "blend"),
    _regime_blend,
    f"""WITH {APPLIED}, w AS (SELECT *, CASE primary_regime WHEN 'peak_scarcity' THEN 0.9 WHEN 'transition' THEN 0.7
        WHEN 'lowprice_midday' THEN 1.0 ELSE CASE WHEN entity = 'click' AND hour NOT BETWEEN 17 AND 20 THEN 0
        ELSE 0.2 END END::DOUBLE AS w FROM regimes)
      SELECT entity, ts, primary_regime, (1 - w) * target + w * w1 AS blend FROM w""",
)


def _gates(s, d):
    df = _apply_regimes(s, d)
    return df.withColumns({f"w_{m}": I.regime_gate(m) for m in I.GATE_WEIGHTS})


def _gate_sql(low: float, normal: float) -> str:
    return (
        f"CASE WHEN primary_regime IN ('transition', 'peak_scarcity') THEN 1.0 "
        f"WHEN primary_regime = 'lowprice_midday' THEN {low} ELSE {normal} END"
    )


register(
    "I10_regime_gate",
    shape("entity ts", "", "w_none w_rule w_conservative w_mid"),
    _gates,
    f"""WITH {APPLIED} SELECT entity, ts, 1.0 AS w_none, {_gate_sql(0.5, 0.3)} AS w_rule,
      {_gate_sql(0.2, 0.1)} AS w_conservative, {_gate_sql(0.35, 0.2)} AS w_mid FROM regimes""",
)


def _adaptive(s, d):
    df, spec = preds(s, d)
    return I.adaptive_blend(
        df,
        _part(df),
        spec,
        "p1",
        "p2",
        "p3",
        anchor_weight=0.6,
        ortho_weight=0.3,
        temperature=1.5,
        peak_boost=1.3,
        max_ortho=0.35,
        delta_std=0.2,
        lo=0.01,
        hi=0.97,
    )


register(
    "I11_adaptive_blend",
    shape("id", "", "ortho_weight blend"),
    _adaptive,
    f"""WITH {PREDS}, {PART}, {bounds_sql(0.01, 0.97)},
      s AS (SELECT *, CASE WHEN sd <= 1e-9 THEN gs ELSE sd END AS std, 0.6::DOUBLE * p1 + (1 - 0.6::DOUBLE) * p2 AS mix FROM b),
      w AS (SELECT *, least(0.35, 0.3::DOUBLE * least(2, greatest(0.5, std / gs))
        * CASE WHEN hour BETWEEN 17 AND 20 THEN 1.3 ELSE 1 END
        * exp(-(abs(p3 - mix) / (std + 1e-9::DOUBLE)) / 1.5))::DOUBLE AS ow FROM s),
      m AS (SELECT *, (1 - ow) * mix + ow * p3 - p1 AS delta, greatest(0.2 * std, 1e-6) AS cap FROM w)
      SELECT id, ow AS ortho_weight, least(greatest(p1 + least(greatest(delta, -cap), cap), lo), hi) AS blend FROM m""",
)


def _swap(s, d):
    df, spec = preds(s, d)
    df = I.peak_swap(df, "p1", "p2", "upper", spec, 0.9, out="upper")
    df = I.peak_swap(df, "p1", "p2", "two_sided", spec, 0.9, 0.1, out="two_sided")
    return I.peak_swap(df, "p1", "p2", "abs", spec, 0.9, out="abs")


register(
    "I12_peak_swap",
    shape("id", "", "upper two_sided abs"),
    _swap,
    f"""WITH {PREDS}, q AS (SELECT quantile_cont(p2, 0.9::DOUBLE) AS h, quantile_cont(p2, 0.1::DOUBLE) AS l,
        quantile_cont(abs(p2), 0.9::DOUBLE) AS a FROM pe)
      SELECT id, CASE WHEN p2 >= h THEN p2 ELSE p1 END AS upper,
        CASE WHEN p2 >= h OR p2 <= l THEN p2 ELSE p1 END AS two_sided,
        CASE WHEN abs(p2) >= a THEN p2 ELSE p1 END AS abs FROM pe, q""",
)


def _topk(s, d):
    df, spec = preds(s, d)
    out = None
    for mode, method in (("largest", "median_non_topk"), ("smallest", "mean_all"), ("abs", "mean_non_topk")):
        part = I.replace_topk(df.select("id", F.col("p2").alias("target")), 40, mode, method, spec)
        part = part.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def _topk_sql(mode: str, value: str) -> str:
    return f"""SELECT '{mode}' AS mode, id, (id IN (SELECT id FROM {mode}_k))::INT AS replaced,
        CASE WHEN id IN (SELECT id FROM {mode}_k) THEN (SELECT {value}) ELSE p2 END AS target FROM pe"""


register(
    "I13_replace_topk",
    shape("mode id", "replaced", "target"),
    _topk,
    f"""WITH {PREDS}, largest_k AS (SELECT id FROM pe ORDER BY p2 DESC, id LIMIT 40),
      smallest_k AS (SELECT id FROM pe ORDER BY p2, id LIMIT 40),
      abs_k AS (SELECT id FROM pe ORDER BY abs(p2) DESC, id LIMIT 40)
      {_topk_sql("largest", "median(p2) FROM pe WHERE id NOT IN (SELECT id FROM largest_k)")} UNION ALL
      {_topk_sql("smallest", "avg(p2) FROM pe")} UNION ALL
      {_topk_sql("abs", "avg(p2) FROM pe WHERE id NOT IN (SELECT id FROM abs_k)")}""",
)


def _bump(s, d):
    df, spec = preds(s, d)
    return I.missing_bump(df.withColumn("missing", F.col("w1").isNull()), "missing", 2.0, spec, "p1")


register(
    "I14_missing_bump",
    shape("id", "", "std_used p1"),
    _bump,
    f"""WITH {PREDS}, x AS (SELECT * FROM pe),
      a AS (SELECT entity, hour, dow, stddev_samp(p1) AS a FROM x GROUP BY ALL),
      b AS (SELECT entity, hour, stddev_samp(p1) AS b FROM x GROUP BY ALL),
      c AS (SELECT entity, stddev_samp(p1) AS c FROM x GROUP BY ALL),
      u AS (SELECT x.*, coalesce(a, b, c, (SELECT stddev_samp(p1) FROM x)) AS std_used
        FROM x JOIN a USING (entity, hour, dow) JOIN b USING (entity, hour) JOIN c USING (entity))
      SELECT id, std_used, CASE WHEN w1 IS NULL THEN p1 + 2 * std_used ELSE p1 END AS p1 FROM u""",
)


def _rowwise(s, d):
    """The row-level blends, with a logistic stand-in for a probability."""
    df, spec = preds(s, d)
    df = df.withColumns(
        {
            "prob": 1.0 / (1.0 + F.exp((F.lit(50.0) - F.col("target")) / 20.0)),
            "missing": F.col("w1").isNull().cast("int"),
            "uplift": F.col("p2") - F.col("p1"),
        }
    )
    return df, spec


PROB = """x AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp((50.0::DOUBLE - target) / 20.0::DOUBLE)) AS prob,
  (w1 IS NULL)::INT AS missing, p2 - p1 AS uplift FROM pe)"""

register(
    "I15_impute_from",
    OUT,
    lambda s, d: _rowwise(s, d)[0].withColumn("target", I.impute_from("p1", "p3", "missing")),
    f"WITH {PREDS} SELECT id, CASE WHEN w1 IS NULL THEN p3 ELSE p1 END AS target FROM pe",
)

register(
    "I16_gate_blend",
    shape("id", "", "hard soft"),
    lambda s, d: _rowwise(s, d)[0].withColumns(
        {
            "hard": I.gate_blend("p1", "p2", "prob", 0.6, "hard"),
            "soft": I.gate_blend("p1", "p2", "prob", 0.6, "soft", 3.0),
        }
    ),
    f"""WITH {PREDS}, {PROB} SELECT id, CASE WHEN prob >= 0.6::DOUBLE THEN p1 + (p2 - p1) ELSE p1 END AS hard,
      p1 + least(greatest((prob - 0.6::DOUBLE) / (1 - 0.6::DOUBLE), 0), 1) * least(greatest(p2 - p1, -3), 3) AS soft FROM x""",
)


def _uplift(s, d):
    df, spec = _rowwise(s, d)
    cap = I.uplift_cap(df.filter("fold <= 3"), "uplift", 0.8, spec)
    return df.withColumn("out", I.power_gate_uplift("p1", "prob", "uplift", 1.5, cap))


register(
    "I17_power_gate_uplift",
    shape("id", "", "out"),
    _uplift,
    f"""WITH {PREDS}, {PROB}, c AS (SELECT greatest(quantile_cont(abs(uplift), 0.8::DOUBLE), 1e-3) AS cap
        FROM x WHERE fold <= 3)
      SELECT id, p1 + pow(prob, 1.5) * least(greatest(uplift, -cap), cap) AS out FROM x, c""",
)

register(
    "I18_side_size",
    shape("id", "", "out"),
    lambda s, d: _rowwise(s, d)[0].withColumn("out", I.side_size("prob", "p2", "p1")),
    f"""WITH {PREDS}, {PROB} SELECT id, (1 - prob) * greatest(p2, 0) - prob * greatest(p1, 0) AS out FROM x""",
)


def _hour_adjust(s, d):
    df, spec = _rowwise(s, d)
    cells = (
        _part(df)
        .groupBy("entity", "hour")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("target") - F.col("p1")).alias("adj"))
    )
    df = df.join(cells, ["entity", "hour"], "left")
    return df.withColumn("out", I.hour_shrink_adjust("p1", "adj", "n", 30, 0.5))


register(
    "I19_hour_shrink_adjust",
    shape("id", "", "out"),
    _hour_adjust,
    f"""WITH {PREDS}, {PART}, c AS (SELECT entity, hour, count(*) AS n, avg(target - p1) AS adj FROM tr GROUP BY ALL)
      SELECT id, p1 + coalesce(0.5::DOUBLE * n / (n + 30.0::DOUBLE) * adj, 0) AS out
      FROM pe LEFT JOIN c USING (entity, hour)""",
)

register(
    "I20_mix_experts",
    shape("id", "", "mixed dual"),
    lambda s, d: _rowwise(s, d)[0].withColumns(
        {
            "mixed": I.mix_experts(
                "p1", [(0.25, I.gated_pair("prob", "p2", "p3")), (0.25, "p2"), (0.1, "w1")]
            ),
            "dual": I.dual_blend("p1", "w1", 3.0, 1.0),
        }
    ),
    f"""WITH {PREDS}, {PROB} SELECT id,
      p1 + 0.25 * (prob * p2 + (1 - prob) * p3) + 0.25 * p2 + 0.1::DOUBLE * w1 AS mixed,
      CASE WHEN w1 IS NULL THEN p1 ELSE 0.75 * p1 + 0.25 * w1 END AS dual FROM x""",
)
