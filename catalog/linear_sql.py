"""SQL of ridge fits with any number of features: normal equations solved by elimination."""

from __future__ import annotations

from collections.abc import Sequence


def ridge_ctes(name: str, rows: str, by: str, xs: Sequence[str], y: str, alpha: float = 25.0, least: int = 1) -> str:
    """CTEs (for WITH RECURSIVE) that end in ``name`` (by, n, mean, icept, coefs, fills): standardised features,
    a free intercept, medians for missing values, one model per ``by`` with ``least`` rows or more."""
    k = len(xs)
    z = [f"(v[{i}] - mu[{i}]) / sd[{i}]" for i in range(1, k + 1)]
    fills = ", ".join(f"coalesce(median({x}), 0)" for x in xs)
    values = ", ".join(f"coalesce({x}, fills[{i}])::DOUBLE" for i, x in enumerate(xs, 1))
    means = ", ".join(f"avg(v[{i}])" for i in range(1, k + 1))
    spreads = ", ".join(
        f"CASE WHEN stddev_pop(v[{i}]) > 1e-12 THEN stddev_pop(v[{i}]) ELSE 1.0::DOUBLE END" for i in range(1, k + 1)
    )
    lines = []
    for i, a in enumerate(z):
        cells = [f"sum({a} * {b})" + (f" + {alpha}::DOUBLE" if i == j else "") for j, b in enumerate(z)]
        lines.append(f"[{', '.join(cells)}, sum({a} * (y - my))]")
    return f"""{name}_f AS (SELECT {by}, [{fills}]::DOUBLE[] AS fills, count(*) AS n FROM {rows} WHERE {y} IS NOT NULL
        GROUP BY {by} HAVING count(*) >= {least}),
      {name}_v AS (SELECT {by}, n, ({y})::DOUBLE AS y, fills, [{values}] AS v FROM {rows} JOIN {name}_f USING ({by}) WHERE {y} IS NOT NULL),
      {name}_m AS (SELECT {by}, avg(y) AS my, [{means}] AS mu, [{spreads}] AS sd FROM {name}_v GROUP BY {by}),
      {name}_g AS (SELECT {by}, any_value(n) AS n, any_value(my) AS my, any_value(mu) AS mu, any_value(sd) AS sd,
        any_value(fills) AS fills, [{", ".join(lines)}] AS a FROM {name}_v JOIN {name}_m USING ({by}) GROUP BY {by}),
      {name}_e AS (SELECT {by}, 1 AS p, a FROM {name}_g UNION ALL
        SELECT {by}, p + 1, list_transform(range(1, {k + 1}), lambda i: list_transform(range(1, {k + 2}), lambda j:
          CASE WHEN i = p THEN a[p][j] / a[p][p] ELSE a[i][j] - a[i][p] * a[p][j] / a[p][p] END))
        FROM {name}_e WHERE p <= {k}),
      {name}_w AS (SELECT {by}, n, my, mu, fills, list_transform(range(1, {k + 1}), lambda i: e.a[i][{k + 1}] / sd[i]) AS coefs
        FROM {name}_e e JOIN {name}_g USING ({by}) WHERE p = {k + 1}),
      {name} AS (SELECT {by}, n, my AS mean, coefs, fills, my - list_dot_product(coefs, mu) AS icept FROM {name}_w)"""


def score(xs: Sequence[str], table: str = "") -> str:
    """The prediction of a row joined with its model."""
    at = f"{table}." if table else ""
    return " + ".join([f"{at}icept", *[f"{at}coefs[{i}] * coalesce({x}, {at}fills[{i}])" for i, x in enumerate(xs, 1)]])
