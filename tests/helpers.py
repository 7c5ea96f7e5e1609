"""Small panels with gaps, ties, missing values and an uneven entity, and frame comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

SCHEMA = "entity string, ts timestamp_ntz, id bigint, target double, x double, y double"


def panel_pdf(n: int = 240, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    next_id = 0
    start = pd.Timestamp("2024-01-01")
    for entity, share in (("a", 1.0), ("b", 0.5), ("c", 0.1)):
        for h in range(n):
            if rng.random() > 0.9 * share:
                continue
            for _ in range(2 if rng.random() < 0.03 else 1):  # a few repeated timestamps
                rows.append(
                    (
                        entity,
                        start + pd.Timedelta(hours=h),
                        next_id,
                        round(float(rng.normal(50, 20)), 3),
                        None if rng.random() < 0.15 else float(rng.integers(0, 12)),
                        round(float(rng.lognormal(3, 2)), 4),
                    )
                )
                next_id += 1
    return pd.DataFrame(rows, columns=["entity", "ts", "id", "target", "x", "y"])


def panel(spark, n: int = 240, seed: int = 3):
    pdf = panel_pdf(n, seed)
    rows = [
        (r.entity, r.ts.to_pydatetime(), r.id, r.target, None if pd.isna(r.x) else r.x, r.y)
        for r in pdf.itertuples()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b, keys, tol: float = 1e-9) -> None:
    """Both frames hold the same rows; numbers within ``tol`` of each other."""
    assert sorted(a.columns) == sorted(b.columns), set(a.columns) ^ set(b.columns)
    cols = sorted(a.columns)
    keys = [keys] if isinstance(keys, str) else list(keys)

    def rows(df):
        got = [tuple(r[c] for c in cols) for r in df.collect()]
        at = [cols.index(k) for k in keys]
        return sorted(got, key=lambda r: tuple(str(r[i]) for i in at))

    left, right = rows(a), rows(b)
    assert len(left) == len(right), (len(left), len(right))
    for p, q in zip(left, right):
        for c, u, v in zip(cols, p, q):
            if isinstance(u, float) and isinstance(v, (float, int)):
                assert math.isclose(u, v, rel_tol=tol, abs_tol=tol), (c, p, q)
            else:
                assert u == v, (c, p, q)
