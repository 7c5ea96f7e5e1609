"""Registered queries against SQL on the smallest tables. ``check.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SAMPLE = (
    "A6_run_leaderboard B3_entity_cutoff C7_holiday_flags D3_rolling D12_robust_cross E4_shrink "
    "E8_empirical_pctl F4_lookup_backoff G1_timestamp_folds H8_compare_predictions I5_soft_cap "
    "J9_walk_forward_oof K2_corr_spearman"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(entry.oracle_sql()[name]).df()
    assert compare(got, want) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["entity"] for r in rows} == {"click", "error", "purchase", "signup", "view"}
