"""All folds from one pass against a fit per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators import folds as G
from panelkit.operators import model as M
from panelkit.operators import onepass as O
from panelkit.operators import profile as P
from panelkit.plans.layout import PanelSpec
from tests.helpers import panel, same

X = ["x", "y", "hour"]
PROFILES = {"p_mh": ["entity", "hour"], "p_m": ["entity"]}


def fit_predict(spec):
    def run(train, val):
        for name, keys in PROFILES.items():
            table = P.profile(train, keys, "q").select(*keys, F.col("q_mean").alias(name))
            train, val = (P.join_table(d, table, keys, spec) for d in (train, val))
        table = M.grouped_ridge(train, ["entity"], [*X, *PROFILES], "target", spec, 3.0)
        return M.predict_ridge(val, table, ["entity"], [*X, *PROFILES], spec)

    return run


@pytest.fixture(scope="module")
def data(spark):
    df = S.calendar(panel(spark, 240))
    odd = F.when(F.col("id") % 17 == 0, float("nan")).when(F.col("id") % 23 == 0, 1e12).otherwise(F.col("y"))
    return df.withColumns({"y": odd, "target": F.when(F.col("id") % 29 != 0, F.col("target"))}).cache()


@pytest.mark.parametrize("chunk", [250_000, 40])
def test_same_as_a_fit_per_fold(spark, data, chunk):
    spec = PanelSpec(chunk_rows=chunk).measured(data)
    folds = G.rolling_date_folds(data, spec, 3, 2, 1, 2)  # validation parts overlap
    got = O.walk_forward_ridge(data.repartition(5), folds, spec, X, PROFILES, alpha=3.0)
    want = M.walk_forward(data, folds, spec, fit_predict(spec))
    same(got, want, ["id", "fold"], 1e-7)


def test_jobs_do_not_grow_with_folds(spark, data):
    spec = PanelSpec().measured(data)
    counts = []
    for n in (2, 6):
        folds = G.rolling_date_folds(data, spec, n, 1, 1, 2)
        folds.collect()
        spark.sparkContext.setJobGroup(f"folds{n}", "")
        assert O.walk_forward_ridge(data, folds, spec, X, PROFILES).select("fold").distinct().count() == n
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 3  # bounds are read by jobs of their own; adaptive execution may add one


def test_unseen_group_and_no_folds(spark, data):
    spec = PanelSpec().measured(data)
    folds = G.rolling_date_folds(data, spec, 2, 1, 1, 2)
    late = data.filter("entity <> 'c' OR ts > timestamp '2024-01-09'")
    rows = O.walk_forward_ridge(late, folds, spec, ["x"]).collect()
    assert any(r.entity != "c" and r.pred is not None for r in rows)
    assert all(r.pred is None for r in rows if r.entity == "c" and r.fold == 1)
    with pytest.raises(ValueError):
        O.walk_forward_ridge(data, folds.filter("false"), spec, ["x"])


def test_weighted_median():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, c = rng.integers(0, 9, 7).astype(float), rng.integers(1, 5, 7)
        assert O.weighted_median(v, c) == np.median(np.repeat(v, c))
