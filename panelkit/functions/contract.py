"""Value rules every operator shares: missing values, flags, safe division, clipping.

Missing is always SQL NULL inside the engine (NaN is turned into NULL by the sources),
comparisons with a missing value count as false, and nothing relies on row order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Num = Column | str | float | int


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Num) -> Column:
    """A column from a name, a column or a plain number."""
    return F.lit(float(c)) if isinstance(c, (int, float)) else col(c)


def null_if_nan(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column of ``df``."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: null_if_nan(n) for n in floats}) if floats else df


def flag(cond: Column) -> Column:
    """0/1 integer; a comparison with a missing value is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def truth(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def clip(c: Num, low: Num | None = None, high: Num | None = None) -> Column:
    """Clip that keeps NULL as NULL and ignores a NULL bound."""
    out = value = num(c)
    if low is not None:
        out = F.greatest(out, num(low))
    if high is not None:
        out = F.least(out, num(high))
    return F.when(value.isNotNull(), out)


def positive(c: Num) -> Column:
    return clip(c, low=0.0)


def ratio(x: Num, y: Num, eps: float = 1e-6) -> Column:
    """x / (y + eps); NULL when the denominator is exactly zero."""
    return F.try_divide(num(x), num(y) + F.lit(eps))


def ratio_floor(x: Num, y: Num, eps: float = 1e-6) -> Column:
    """x / max(y, eps)."""
    return num(x) / clip(y, low=eps)


def safe_corr(x: Num, y: Num) -> Column:
    """Pearson correlation over rows where both are present; NULL on a constant side."""
    x, y = num(x), num(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rmse(err: Num) -> Column:
    e = num(err)
    return F.sqrt(F.avg(e * e))


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def has(df: DataFrame, *cols: str) -> bool:
    return set(cols) <= set(df.columns)


def epoch_micros(ts: str | Column) -> Column:
    """Wall-clock microseconds since 1970, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", wall_clock("1970-01-01"), col(ts))


def wall_clock(value: object) -> Column:
    """Literal wall-clock time from a date, a naive datetime or text, whatever the zones."""
    return F.lit(str(value)).cast("timestamp_ntz")


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)
