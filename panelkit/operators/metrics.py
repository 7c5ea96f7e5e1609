"""Error metrics and diagnostics over tables with a target and a prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.contract import as_list, rmse, safe_corr, truth
from panelkit.operators.profile import join_table, summarize, table_bound
from panelkit.plans.layout import PanelSpec, attach, row_scalars
from panelkit.plans.ranks import first_rows, quantiles


def error_metrics(
    df: DataFrame, spec: PanelSpec, by: Sequence[str] | str = (), pred: str = "pred"
) -> DataFrame:
    """n, rmse, mae, bias and the 90th / 95th percentile of the absolute error."""
    err = F.col(pred) - F.col(spec.target)
    return summarize(
        df,
        as_list(by),
        {
            "n": F.count(F.lit(1)),
            "rmse": rmse(err),
            "mae": F.avg(F.abs(err)),
            "bias": F.avg(err),
        },
        {"p90_abs_error": (F.abs(err), 0.9), "p95_abs_error": (F.abs(err), 0.95)},
        spec,
    )


def tail_metrics(
    df: DataFrame, spec: PanelSpec, lo: float = 0.01, hi: float = 0.99, pred: str = "pred"
) -> DataFrame:
    """Errors in each entity's target tails against the body."""
    e, y = spec.entity, F.col(spec.target)
    bounds = quantiles(df, [e], {"q_low": (spec.target, lo), "q_high": (spec.target, hi)}, spec)
    tail = truth((y <= F.col("q_low")) | (y >= F.col("q_high")))
    err = F.col(pred) - y
    out = (
        join_table(df, bounds, [e], spec)
        .groupBy(e)
        .agg(
            F.max("q_low").alias("q_low"),
            F.max("q_high").alias("q_high"),
            F.count_if(tail).alias("tail_n"),
            F.count_if(~tail).alias("body_n"),
            rmse(F.when(tail, err)).alias("tail_rmse"),
            rmse(F.when(~tail, err)).alias("body_rmse"),
            F.avg(F.when(tail, F.abs(err))).alias("tail_mae"),
            F.avg(F.when(~tail, F.abs(err))).alias("body_mae"),
        )
    )
    return out.withColumn("tail_minus_body_rmse", F.col("tail_rmse") - F.col("body_rmse"))


def fold_metrics(oof: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    """rmse and number of predicted rows per fold."""
    scored = oof.filter(F.col(pred).isNotNull())
    return scored.groupBy("fold").agg(
        rmse(F.col(pred) - F.col(spec.target)).alias("rmse"),
        F.count(F.lit(1)).alias("val_rows"),
        F.min(spec.ts).alias("val_first"),
        F.max(spec.ts).alias("val_last"),
    )


def fold_summary(oof: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    """One row: mean, last-two mean, population std and worst of the fold rmses, their
    row-weighted mean, the pooled rmse, and the share of rows with a prediction."""
    folds = fold_metrics(oof, spec, pred)
    # Fold tables have a handful of rows, so the last two fit one sorted array.
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("fold", "rmse"))), lambda x: x.rmse
    )
    last = F.slice(ordered, F.greatest(F.size(ordered) - 1, F.lit(1)), F.lit(2))
    table = folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("rmse").alias("rmse_mean_all"),
        (F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)).alias(
            "rmse_mean_last2"
        ),
        F.stddev_pop("rmse").alias("rmse_std"),
        F.max("rmse").alias("rmse_worst"),
        F.try_divide(F.sum(F.col("rmse") * F.col("val_rows")), F.sum("val_rows")).alias(
            "rmse_row_weighted"
        ),
    )
    pooled = oof.agg(
        rmse(F.col(pred) - F.col(spec.target)).alias("rmse_pooled"),
        F.avg(F.col(pred).isNotNull().cast("int")).alias("coverage"),
    )
    return table.withColumns(row_scalars(pooled))


def peak_detection(
    df: DataFrame, spec: PanelSpec, q: float, pred: str = "pred", eps: float = 1e-9
) -> DataFrame:
    """How well predictions above the entity's target quantile hit the real ones."""
    e = spec.entity
    cut = quantiles(df, [e], {"threshold": (spec.target, q)}, spec)
    actual = truth(F.col(spec.target) >= F.col("threshold"))
    guess = truth(F.col(pred) >= F.col("threshold"))
    out = (
        join_table(df, cut, [e], spec)
        .groupBy(e)
        .agg(
            F.max("threshold").alias("threshold"),
            F.count_if(actual & guess).alias("tp"),
            F.count_if(~actual & guess).alias("fp"),
            F.count_if(actual & ~guess).alias("fn"),
        )
    )
    tp = F.col("tp")
    p, r = tp / (tp + F.col("fp") + eps), tp / (tp + F.col("fn") + eps)
    return out.withColumns(
        {
            "precision": F.try_divide(tp, tp + F.col("fp")),
            "recall": F.try_divide(tp, tp + F.col("fn")),
            "f1": F.when(tp == 0, 0.0).otherwise(2.0 * p * r / (p + r + eps)),
        }
    )


def hour_subset_rmse(
    df: DataFrame, spec: PanelSpec, hours: Sequence[int], pred: str = "pred"
) -> DataFrame:
    part = df.filter(F.col("hour").isin(*hours))
    return part.agg(
        F.count(F.lit(1)).alias("n"), rmse(F.col(pred) - F.col(spec.target)).alias("rmse")
    )


def _cells(df: DataFrame, by: Sequence[str], c: str, prefix: str, spec: PanelSpec) -> DataFrame:
    return summarize(
        df,
        by,
        {
            f"{prefix}_n": F.count(F.lit(1)),
            f"{prefix}_mean": F.avg(c),
            f"{prefix}_std": F.stddev_samp(c),
        },
        {
            f"{prefix}_median": (F.col(c), 0.5),
            f"{prefix}_p05": (F.col(c), 0.05),
            f"{prefix}_p95": (F.col(c), 0.95),
        },
        spec,
    )


def distribution_shift(
    train: DataFrame, test: DataFrame, by: Sequence[str], spec: PanelSpec, pred: str = "pred"
) -> DataFrame:
    """Cell statistics of test predictions beside those of the training target."""
    out = join_table(
        _cells(test, by, pred, "pred", spec), _cells(train, by, spec.target, "train", spec), by, spec
    )
    shift = F.col("pred_mean") - F.col("train_mean")
    return out.withColumns(
        {
            "mean_shift": shift,
            "mean_shift_z": shift / (F.col("train_std") + 1e-6),
            "p95_excess": F.col("pred_p95") - F.col("train_p95"),
        }
    )


def oof_vs_test(
    oof: DataFrame, test: DataFrame, by: Sequence[str], spec: PanelSpec, pred: str = "pred"
) -> DataFrame:
    """Cell mean / std of test predictions minus those of out-of-fold predictions."""

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.avg(pred).alias(f"{prefix}_mean"),
            F.stddev_samp(pred).alias(f"{prefix}_std"),
            F.count(F.lit(1)).alias(f"{prefix}_n"),
        )

    out = join_table(cells(test, "test"), cells(oof, "oof"), by, spec)
    return out.withColumns(
        {
            "mean_delta": F.col("test_mean") - F.col("oof_mean"),
            "std_delta": F.col("test_std") - F.col("oof_std"),
        }
    )


def compare_predictions(
    df: DataFrame, a: str, b: str, spec: PanelSpec, by: Sequence[str] | str = ()
) -> DataFrame:
    """Difference statistics of two prediction columns (b - a)."""
    by = as_list(by)
    diff = F.col(b) - F.col(a)
    size = F.abs(diff)
    want = {"p95": (size, 0.95), "p99": (size, 0.99)}
    table = quantiles(df, by, want, spec)
    if by:
        df = attach(df, table, by, table_bound(spec, by))
    else:
        df = df.withColumns(row_scalars(table))
    top = F.when(size >= F.col("p95"), size)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        safe_corr(a, b).alias("corr"),
        rmse(diff).alias("rmse_diff"),
        F.avg(size).alias("mae_diff"),
        F.avg(diff).alias("mean_diff"),
        F.max(size).alias("max_abs_diff"),
        F.max("p95").alias("abs_diff_p95"),
        F.max("p99").alias("abs_diff_p99"),
        F.coalesce(F.avg(top), F.lit(0.0)).alias("abs_diff_top5_mean"),
        F.avg((diff > 0).cast("int")).alias("share_b_higher"),
    )


def worst_cells(
    metrics: DataFrame, k: int, min_rows: int, keys: Sequence[str], by: str = "rmse"
) -> DataFrame:
    """The k cells of largest error among those with enough rows; ties by key."""
    order = [F.col(by).isNull(), -F.col(by), *[F.col(c) for c in keys]]
    return first_rows(metrics.filter(F.col("n") >= min_rows), order, k)


def worst_rows(df: DataFrame, k: int, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    """The k rows of largest absolute error; ties by id."""
    size = F.abs(F.col(pred) - F.col(spec.target))
    out = df.withColumn("abs_error", size)
    return first_rows(out, [F.col("abs_error").isNull(), -F.col("abs_error"), F.col(spec.id)], k)


def run_delta(
    a: DataFrame, b: DataFrame, by: Sequence[str] | str, spec: PanelSpec, pred: str = "pred"
) -> DataFrame:
    """rmse of two runs per group and their difference (b - a)."""
    by = as_list(by)
    err = F.col(pred) - F.col(spec.target)
    left, right = (
        d.groupBy(*by).agg(rmse(err).alias(name)) for d, name in ((a, "rmse_a"), (b, "rmse_b"))
    )
    out = attach(left, right, by, table_bound(spec, by), how="inner")
    return out.withColumn("delta", F.col("rmse_b") - F.col("rmse_a"))
