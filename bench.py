"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from panelkit.plans.session import local_session

HEADLINE = (
    "D1_lags D3_rolling D5_volatility D9_expanding_prev D10_cross_section D11_pct_rank_avg "
    "D14_rolling_pair_corr E4_shrink E8_empirical_pctl E13_apply_regimes F2_align_predictions "
    "G1_timestamp_folds H1_error_metrics H8_compare_predictions I4_guardrail I11_adaptive_blend "
    "J3_lambda_search J9_walk_forward_errors J14_correlation_groups J15_permutation_importance "
    "K2_corr_pearson K4_lead_lag"
).split()


def main() -> None:
    from catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    QUERIES["D1_lags"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
