"""From events to session and season panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, safe_ratio
from ..sources.tables import cut
from .ranks import exact_quantiles


def count_flags(names: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(n)).alias(n) for n in names]


def aggregate(events: DataFrame, keys: Sequence[str], flags: Sequence[str], means: Sequence[str] = (), ratios: Mapping[str, tuple[Column, Column]] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """One pass over events: how many, how many with each flag, means, ratios of sums."""
    ratios = ratios or {}
    sums = [safe_ratio(F.sum(a), F.sum(b)).alias(n) for n, (a, b) in ratios.items()]
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"), *count_flags(flags), *[F.avg(m).alias(f"avg_{m}") for m in means], *sums, *extra)


def with_rates(panel: DataFrame, rates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rates as guarded ratios of count columns."""
    return panel.withColumns({name: safe_ratio(a, b) for name, (a, b) in rates.items()})


def first_by(value: str, *order: str) -> Column:
    """The value of the first row in ``order`` that has one."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))


def starters(events: DataFrame, side: Sequence[str], entity: str, order: Sequence[str]) -> DataFrame:
    """Events of the entity that came first on each side of a session; first by explicit order.

    One exchange by side; a side is one session's events, so a window holds few rows.
    """
    first = first_by(entity, *order, entity).over(Window.partitionBy(*side))
    return events.withColumn("_first", first).where(F.col(entity) == F.col("_first")).drop("_first")


def qualified(panel: DataFrame, thresholds: Column) -> DataFrame:
    return panel.where(flag(thresholds))


def season_thresholds(rules: Mapping[int, tuple[int, int]], default: tuple[int, int], season: str = "season", sessions: str = "n_sessions", events: str = "n_events") -> Column:
    """At least so many sessions and events, by season."""
    s, e = F.lit(default[0]), F.lit(default[1])
    for year, (least_s, least_e) in rules.items():
        s = F.when(F.col(season) == year, least_s).otherwise(s)
        e = F.when(F.col(season) == year, least_e).otherwise(e)
    return (F.col(sessions) >= s) & (F.col(events) >= e)


def category_panel(events: DataFrame, keys: Sequence[str], family: str, families: Sequence[str], measures: Sequence[str], least: int) -> DataFrame:
    """Mean of each measure by family as columns ``family_measure``, NULL under ``least`` values; one grouping."""
    out = []
    for f in families:
        for m in measures:
            own = F.when(F.col(family) == f, F.col(m))
            out.append(F.when(F.count(own) >= least, F.avg(own)).alias(f"{f}_{m}".lower()))
    return events.groupBy(*keys).agg(*out)


def mix_entropy(events: DataFrame, keys: Sequence[str], category: str, least_share: float = 0.02) -> DataFrame:
    """Entropy of the category mix of each key; shares under ``least_share`` are left out, the rest not rescaled."""
    counts = events.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    kept = counts.withColumn("p", share).where(F.col("p") >= least_share)
    return kept.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("mix_entropy"))


def with_next(panel: DataFrame, entity: str, season: str, names: Mapping[str, str]) -> DataFrame:
    """Columns of the season after a row's own, by new name and column; NULL where that season is missing. One row an (entity, season)."""
    w = Window.partitionBy(entity).orderBy(season)
    follows = F.lead(season).over(w) == F.col(season) + 1
    return panel.withColumns({new: F.when(follows, F.lead(old).over(w)) for new, old in names.items()})


def lag_join(panel: DataFrame, entity: str, season: str, features: Sequence[str], target: str) -> DataFrame:
    """Features of a season beside the target of the season after it, for all transitions at once and without a join."""
    pairs = with_next(panel, entity, season, {"to_season": season, f"next_{target}": target}).where("to_season is not null")
    return pairs.select(entity, F.col(season).alias("from_season"), *features, "to_season", f"next_{target}")


def paired_seasons(panel: DataFrame, entity: str, season: str, prior: int, current: int, names: Sequence[str]) -> DataFrame:
    """One row an entity found in either season, both seasons' columns side by side."""
    a = panel.where(F.col(season) == prior).select(entity, *[F.col(n).alias(f"prior_{n}") for n in names])
    b = panel.where(F.col(season) == current).select(entity, *[F.col(n).alias(f"current_{n}") for n in names])
    return a.join(b, entity, "full_outer")


def with_fallback(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows, and the old ones of keys that the new rows lack."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null count of each column, in one pass, as rows."""
    counts = df.agg(*[F.count(n).alias(n) for n in names])
    return counts.unpivot([], list(names), "feature", "n_present")


def describe(df: DataFrame, name: str, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Mean, exact median, extremes and sample deviation of a column by group, beside ``extra`` aggregates."""
    rows = cut(df)
    aggs = [*extra, F.avg(name).alias("mean"), F.min(name).alias("least"), F.max(name).alias("most"), F.stddev_samp(name).alias("std")]
    medians = exact_quantiles(rows, name, [0.5], by).withColumn("median", F.col("quantiles")[0]).drop("quantiles")
    if not by:
        return rows.agg(*aggs).crossJoin(F.broadcast(medians))
    return rows.groupBy(*by).agg(*aggs).join(medians, list(by))


def named(df: DataFrame, names: DataFrame, key: str, name_key: str, name: str, out: str = "name") -> DataFrame:
    """``df`` with the name of each key; NULL for an unknown one, the smallest where a key has several."""
    one = names.groupBy(F.col(name_key).alias(key)).agg(F.min(name).alias(out))
    return df.join(one, key, "left")
