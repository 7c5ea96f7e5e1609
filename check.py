"""Run registered queries next to their SQL counterparts: python check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import sys
import time

import duckdb
from panelkit.plans.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple("NULL" if v is None or v != v else repr(_plain(v)) for v in r)
            for r in pdf.astype(object).itertuples(index=False)]
    return list(pdf.columns), sorted(rows)


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def compare(got, want) -> str:
    gc, g = canonical(got)
    wc, w = canonical(want)
    if gc != wc:
        return f"columns differ: {sorted(set(gc) ^ set(wc))}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in gc]
    if any(a != b for _, a, b in kinds):
        return f"types differ: {[k for k in kinds if k[1] != k[2]]}"
    if len(g) != len(w):
        return f"rows differ: {len(g)} / {len(w)}"
    if not g:
        return "no rows"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        cols = sorted({c for a, b in bad[:50] for c, x, y in zip(gc, a, b) if x != y})
        return f"{len(bad)} of {len(g)} rows differ in {cols}: {bad[0]}"
    return ""


def main(sf_dir: str, prefixes: list[str]) -> int:
    from catalog import ORACLES, QUERIES

    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name, query in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in ORACLES:
                note = compare(got, con.execute(ORACLES[name]).df())
            else:
                note = "" if len(got) else "no rows"
        except Exception as e:  # report and go on with the next query
            t1, got = time.time(), ()
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(note)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if note else 'ok  '} {kind} {name:38s} {len(got):7d} rows {t1 - t0:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf, args) else 0)
