"""Scalar expressions over panel columns. A missing value is NULL and stays NULL unless stated."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """A condition that is false, not NULL, where its inputs are missing."""
    return F.coalesce(condition, F.lit(False))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, NULL where the denominator is 0 or missing."""
    return col(num) / F.nullif(col(den).cast("double"), F.lit(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation of the pairs as an aggregate; NULL where either side doesn't vary, at which ``corr`` fails under ANSI rules."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def clip_lower(x: str | Column, least: float) -> Column:
    """Values under ``least`` become it."""
    x = col(x)
    return F.when(x < least, F.lit(least)).otherwise(x)


def lenient_double(x: str | Column) -> Column:
    """The number that a text holds, NULL for any other text and for NaN."""
    value = col(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def weighted_score(weights: Mapping[str, float]) -> Column:
    """A linear scoring rule from a map of columns to weights."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(float(weight))
    return total


def shrink(x: str | Column, n: str | Column, prior: float, strength: float) -> Column:
    """A mean of ``n`` observations drawn to ``prior`` as by ``strength`` more of them."""
    return (col(n) * col(x) + F.lit(strength * prior)) / (col(n) + F.lit(float(strength)))


def shrink_two(x1: Column, n1: Column, x2: Column, n2: Column, prior: float, strength: float) -> Column:
    """Two samples pooled and drawn to the prior; a missing mean counts as the prior."""
    a, b = F.coalesce(x1, F.lit(prior)), F.coalesce(x2, F.lit(prior))
    m1, m2 = F.coalesce(n1, F.lit(0)), F.coalesce(n2, F.lit(0))
    return (m1 * a + m2 * b + F.lit(strength * prior)) / (m1 + m2 + F.lit(float(strength)))


def blend(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Two rates weighted by their samples; where one is missing, the other."""
    return F.when(x1.isNull(), x2).when(x2.isNull(), x1).otherwise((n1 * x1 + n2 * x2) / F.nullif((n1 + n2).cast("double"), F.lit(0.0)))


#: Ways to score a model by its correlation r and its cohort bias k.
SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "linear_050": lambda r, k: 3 * r - 0.5 * F.abs(k),
    "linear_025": lambda r, k: 3 * r - 0.25 * F.abs(k),
    "linear_010": lambda r, k: 3 * r - 0.1 * F.abs(k),
    "linear_100": lambda r, k: 3 * r - F.abs(k),
    "tolerance_050": lambda r, k: 3 * r - 0.5 * clip_lower(F.abs(k) - 0.5, 0.0),
    "tolerance_070": lambda r, k: 3 * r - 0.5 * clip_lower(F.abs(k) - 0.7, 0.0),
    "tolerance_100": lambda r, k: 3 * r - 0.5 * clip_lower(F.abs(k) - 1.0, 0.0),
    "quadratic_050": lambda r, k: 3 * r - 0.5 * k * k,
    "quadratic_025": lambda r, k: 3 * r - 0.25 * k * k,
    "floored": lambda r, k: 3 * r + 0.5 * clip_lower(0.21 - F.abs(k), 0.0),
}


def approach_angle(vy: Column, vz: Column, ay: Column, az: Column, extension: Column) -> Column:
    """Angle in degrees at which a projectile arrives; NULL where it never does."""
    distance = F.lit(60.5) - extension - F.lit(1.417)
    inside = vy * vy - 2 * ay * distance
    t = (-vy - F.when(inside >= 0, F.sqrt(inside))) / F.nullif(ay, F.lit(0.0))
    return F.degrees(F.atan((vz + az * t) / F.nullif(F.abs(vy + ay * t), F.lit(0.0))))


def strip_tags(x: str | Column) -> Column:
    """Text without markup, trimmed."""
    return F.trim(F.regexp_replace(col(x), "<[^>]+>", ""))


def family_of(x: str | Column, families: Mapping[str, Sequence[str]]) -> Column:
    """The family that lists a category, NULL for one that none lists."""
    out = F.lit(None).cast("string")
    for family, members in families.items():
        out = F.when(col(x).isin(*members), F.lit(family)).otherwise(out)
    return out


def by_key(key: str | Column, values: Mapping[str, str]) -> Column:
    """Value of a key in a fixed map, NULL for other keys."""
    pairs = [F.lit(v) for kv in values.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that the frame has, in their order, each once."""
    return [n for n in dict.fromkeys(names) if n in df.columns]


def rescale_percents(df: DataFrame, suffix: str = "_pct") -> DataFrame:
    """Columns with ``suffix`` whose values all lie in 0 to 1 become percents, rounded to 2 digits.

    One aggregate decides for all columns; its single row is joined back.
    """
    names = [c for c in df.columns if c.endswith(suffix)]
    if not names:
        return df
    tests = df.agg(*[F.bool_and(F.col(c).between(0, 1)).alias(f"_{c}") for c in names])
    out = df.crossJoin(F.broadcast(tests))
    scaled = {c: F.when(F.col(f"_{c}"), F.round(F.col(c) * 100, 2)).otherwise(F.col(c)) for c in names}
    return out.withColumns(scaled).select(df.columns)


def impute_median(df: DataFrame, names: Sequence[str], pool: DataFrame | None = None) -> DataFrame:
    """Missing values of ``names`` become the exact median over ``pool``."""
    from ..operators.ranks import exact_quantiles

    long = (df if pool is None else pool).select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "_name", "_value")
    medians = exact_quantiles(long, "_value", [0.5], by=["_name"])
    one = medians.agg(*[F.max(F.when(F.col("_name") == c, F.col("quantiles")[0])).alias(f"_{c}") for c in names])
    out = df.crossJoin(F.broadcast(one))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in names}).select(df.columns)
