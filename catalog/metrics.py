"""Queries for error metrics and diagnostics, on the event-level prediction table."""

from pyspark.sql import functions as F

from catalog.common import PREDS, register, shape
from panelkit.functions import scalar as S
from panelkit.operators import metrics as M
from panelkit.plans import panels
from panelkit.plans.panels import SPEC


def preds(s, d):
    df = S.calendar(panels.events(s, d))
    return df, SPEC.measured(df)


METRIC_SQL = """count(*) AS n, sqrt(avg((p1 - target) * (p1 - target))) AS rmse, avg(abs(p1 - target)) AS mae,
  avg(p1 - target) AS bias, quantile_cont(abs(p1 - target), 0.9::DOUBLE) AS p90_abs_error,
  quantile_cont(abs(p1 - target), 0.95::DOUBLE) AS p95_abs_error"""


def _errors(s, d):
    df, spec = preds(s, d)
    parts = []
    for by in ([], ["entity"], ["entity", "hour"]):
        part = M.error_metrics(df, spec, by, "p1")
        for k in ("entity", "hour"):
            if k not in by:
                part = part.withColumn(k, F.lit(None).cast("string" if k == "entity" else "int"))
        parts.append(part)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register(
    "H1_error_metrics",
    shape("entity", "n", "hour rmse mae bias p90_abs_error p95_abs_error"),
    _errors,
    f"""WITH {PREDS} SELECT NULL::VARCHAR AS entity, NULL::INT AS hour, {METRIC_SQL} FROM pe
      UNION ALL SELECT entity, NULL, {METRIC_SQL} FROM pe GROUP BY entity
      UNION ALL SELECT entity, hour, {METRIC_SQL} FROM pe GROUP BY entity, hour""",
)


def _tails(s, d):
    df, spec = preds(s, d)
    return M.tail_metrics(df, spec, 0.05, 0.95, "p1")


register(
    "H2_tail_metrics",
    shape(
        "entity",
        "tail_n body_n",
        "q_low q_high tail_rmse body_rmse tail_mae body_mae tail_minus_body_rmse",
    ),
    _tails,
    f"""WITH {PREDS}, q AS (SELECT entity, quantile_cont(target, 0.05::DOUBLE) AS q_low,
        quantile_cont(target, 0.95::DOUBLE) AS q_high FROM pe GROUP BY 1),
      e AS (SELECT *, p1 - target AS e, target <= q_low OR target >= q_high AS tail FROM pe JOIN q USING (entity)),
      r AS (SELECT entity, max(q_low) AS q_low, max(q_high) AS q_high, count(*) FILTER (tail) AS tail_n,
        count(*) FILTER (NOT tail) AS body_n, sqrt(avg(e * e) FILTER (tail)) AS tail_rmse,
        sqrt(avg(e * e) FILTER (NOT tail)) AS body_rmse, avg(abs(e)) FILTER (tail) AS tail_mae,
        avg(abs(e)) FILTER (NOT tail) AS body_mae FROM e GROUP BY 1)
      SELECT *, tail_rmse - body_rmse AS tail_minus_body_rmse FROM r""",
)


def _fold_metrics(s, d):
    df, spec = preds(s, d)
    return M.fold_metrics(df.withColumn("p", F.when(F.col("w1").isNotNull(), F.col("p1"))), spec, "p")


register(
    "H3_fold_metrics",
    shape("val_first val_last", "fold val_rows", "rmse"),
    _fold_metrics,
    f"""WITH {PREDS} SELECT fold, sqrt(avg((p1 - target) * (p1 - target))) AS rmse, count(*) AS val_rows,
      min(ts) AS val_first, max(ts) AS val_last FROM pe WHERE w1 IS NOT NULL GROUP BY 1""",
)


def _fold_summary(s, d):
    df, spec = preds(s, d)
    return M.fold_summary(df.withColumn("p", F.when(F.col("w1").isNotNull(), F.col("p1"))), spec, "p")


register(
    "H3_fold_summary",
    shape(
        "",
        "n_folds",
        "rmse_mean_all rmse_mean_last2 rmse_std rmse_worst rmse_row_weighted rmse_pooled coverage",
    ),
    _fold_summary,
    f"""WITH {PREDS}, f AS (SELECT fold, sqrt(avg((p1 - target) * (p1 - target))) AS rmse, count(*) AS n
        FROM pe WHERE w1 IS NOT NULL GROUP BY 1)
      SELECT count(*) AS n_folds, avg(rmse) AS rmse_mean_all,
        (SELECT avg(rmse) FROM (SELECT rmse FROM f ORDER BY fold DESC LIMIT 2)) AS rmse_mean_last2,
        stddev_pop(rmse) AS rmse_std, max(rmse) AS rmse_worst, sum(rmse * n) / sum(n) AS rmse_row_weighted,
        (SELECT sqrt(avg((p1 - target) * (p1 - target))) FROM pe WHERE w1 IS NOT NULL) AS rmse_pooled,
        (SELECT count(w1) / count(*) FROM pe) AS coverage FROM f""",
)


def _peaks(s, d):
    df, spec = preds(s, d)
    return M.peak_detection(df, spec, 0.9, "p2")


register(
    "H4_peak_detection",
    shape("entity", "tp fp fn", "threshold precision recall f1"),
    _peaks,
    f"""WITH {PREDS}, q AS (SELECT entity, quantile_cont(target, 0.9::DOUBLE) AS threshold FROM pe GROUP BY 1),
      c AS (SELECT entity, max(threshold) AS threshold,
        count(*) FILTER (target >= threshold AND p2 >= threshold) AS tp,
        count(*) FILTER (target < threshold AND p2 >= threshold) AS fp,
        count(*) FILTER (target >= threshold AND p2 < threshold) AS fn FROM pe JOIN q USING (entity) GROUP BY 1),
      r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
        tp / (tp + fp + 1e-9::DOUBLE) AS p, tp / (tp + fn + 1e-9::DOUBLE) AS r FROM c)
      SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * p * r / (p + r + 1e-9::DOUBLE) END AS f1 FROM r""",
)


def _hours(s, d):
    df, spec = preds(s, d)
    return M.hour_subset_rmse(df, spec, [18, 19], "p1")


register(
    "H5_hour_subset_rmse",
    shape("", "n", "rmse"),
    _hours,
    f"""WITH {PREDS} SELECT count(*) AS n, sqrt(avg((p1 - target) * (p1 - target))) AS rmse
      FROM pe WHERE hour IN (18, 19)""",
)


def _two_parts(s, d):
    df, spec = preds(s, d)
    return df.filter("fold <= 3"), df.filter("fold > 3"), spec


def _shift(s, d):
    train, test, spec = _two_parts(s, d)
    return M.distribution_shift(train, test, ["entity", "hour"], spec, "p1")


def _cell_sql(c: str, prefix: str, cond: str) -> str:
    return f"""(SELECT entity, hour, count(*) AS {prefix}_n, avg({c}) AS {prefix}_mean,
      stddev_samp({c}) AS {prefix}_std, median({c}) AS {prefix}_median,
      quantile_cont({c}, 0.05::DOUBLE) AS {prefix}_p05, quantile_cont({c}, 0.95::DOUBLE) AS {prefix}_p95
      FROM pe WHERE {cond} GROUP BY ALL)"""


register(
    "H6_distribution_shift",
    shape(
        "entity",
        "hour pred_n train_n",
        "pred_mean pred_median pred_std pred_p05 pred_p95 train_mean train_median train_std train_p05 "
        "train_p95 mean_shift mean_shift_z p95_excess",
    ),
    _shift,
    f"""WITH {PREDS} SELECT *, pred_mean - train_mean AS mean_shift,
        (pred_mean - train_mean) / (train_std + 1e-6::DOUBLE) AS mean_shift_z, pred_p95 - train_p95 AS p95_excess
      FROM {_cell_sql("p1", "pred", "fold > 3")} LEFT JOIN {_cell_sql("target", "train", "fold <= 3")}
        USING (entity, hour)""",
)


def _oof_test(s, d):
    train, test, spec = _two_parts(s, d)
    return M.oof_vs_test(train, test, ["entity", "hour"], spec, "p1")


register(
    "H7_oof_vs_test",
    shape("entity", "hour test_n oof_n", "test_mean test_std oof_mean oof_std mean_delta std_delta"),
    _oof_test,
    f"""WITH {PREDS} SELECT entity, hour, pred_n AS test_n, train_n AS oof_n, pred_mean AS test_mean,
        pred_std AS test_std, train_mean AS oof_mean, train_std AS oof_std,
        pred_mean - train_mean AS mean_delta, pred_std - train_std AS std_delta
      FROM {_cell_sql("p1", "pred", "fold > 3")} LEFT JOIN {_cell_sql("p1", "train", "fold <= 3")}
        USING (entity, hour)""",
)


def _compare(s, d):
    df, spec = preds(s, d)
    all_rows = M.compare_predictions(df, "p1", "p2", spec).withColumn(
        "entity", F.lit(None).cast("string")
    )
    return M.compare_predictions(df, "p1", "p2", spec, "entity").unionByName(all_rows)


def _compare_sql(entity: str, group: str) -> str:
    return f"""SELECT {entity} AS entity, count(*) AS rows, avg(p1) AS mean_a, avg(p2) AS mean_b, corr(p1, p2) AS corr,
        sqrt(avg(d * d)) AS rmse_diff, avg(abs(d)) AS mae_diff, avg(d) AS mean_diff, max(abs(d)) AS max_abs_diff,
        max(q95) AS abs_diff_p95, max(q99) AS abs_diff_p99, avg(abs(d)) FILTER (abs(d) >= q95) AS abs_diff_top5_mean,
        avg((d > 0)::INT) AS share_b_higher
      FROM (SELECT *, quantile_cont(abs(d), 0.95::DOUBLE) OVER ({group}) AS q95,
        quantile_cont(abs(d), 0.99::DOUBLE) OVER ({group}) AS q99 FROM df) {"GROUP BY entity" if group else ""}"""


register(
    "H8_compare_predictions",
    shape(
        "entity",
        "rows",
        "mean_a mean_b corr rmse_diff mae_diff mean_diff max_abs_diff abs_diff_p95 abs_diff_p99 "
        "abs_diff_top5_mean share_b_higher",
    ),
    _compare,
    f"""WITH {PREDS}, df AS (SELECT *, p2 - p1 AS d FROM pe)
      {_compare_sql("entity", "PARTITION BY entity")} UNION ALL {_compare_sql("NULL::VARCHAR", "")}""",
)


def _worst_cells(s, d):
    df, spec = preds(s, d)
    return M.worst_cells(
        M.error_metrics(df, spec, ["entity", "hour"], "p1"), 15, 30, ["entity", "hour"]
    )


register(
    "H9_worst_cells",
    shape("entity", "hour n", "rmse mae bias"),
    _worst_cells,
    f"""WITH {PREDS}, m AS (SELECT entity, hour, {METRIC_SQL} FROM pe GROUP BY ALL)
      SELECT * FROM m WHERE n >= 30 ORDER BY rmse DESC, entity, hour LIMIT 15""",
)


def _worst_rows(s, d):
    df, spec = preds(s, d)
    return M.worst_rows(df, 25, spec, "p3")


register(
    "H9_worst_rows",
    shape("entity ts", "id", "target p3 abs_error"),
    _worst_rows,
    f"""WITH {PREDS} SELECT *, abs(p3 - target) AS abs_error FROM pe
      ORDER BY abs_error DESC, id LIMIT 25""",
)


def _delta(s, d):
    df, spec = preds(s, d)
    a = df.withColumn("pred", F.col("p1"))
    b = df.withColumn("pred", F.col("p2"))
    return M.run_delta(a, b, ["entity", "hour"], spec)


register(
    "H10_run_delta",
    shape("entity", "hour", "rmse_a rmse_b delta"),
    _delta,
    f"""WITH {PREDS}, r AS (SELECT entity, hour, sqrt(avg((p1 - target) * (p1 - target))) AS rmse_a,
        sqrt(avg((p2 - target) * (p2 - target))) AS rmse_b FROM pe GROUP BY ALL)
      SELECT *, rmse_b - rmse_a AS delta FROM r""",
)
