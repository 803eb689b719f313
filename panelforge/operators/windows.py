"""Window features of panels: lags, running and rolling means, ranks, bins, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .ranks import exact_quantiles


def lags(df: DataFrame, entity: str, order: Sequence[str], names: Sequence[str], steps: Sequence[int] = (1, 2)) -> DataFrame:
    """Values of earlier rows of the entity; a skipped season doesn't count as a row."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({f"{n}_lag{k}": F.lag(n, k).over(w) for n in names for k in steps})


def expanding_mean(name: str, entity: str, *order: str) -> Column:
    """Mean of all earlier rows."""
    return F.avg(name).over(Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def rolling_mean(name: str, entity: str, order: Sequence[str], rows: int, least: int = 1) -> Column:
    """Mean of the ``rows`` rows before, where at least ``least`` of them have a value."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-rows, -1)
    return F.when(F.count(name).over(w) >= least, F.avg(name).over(w))


def competition_rank(name: str, *partition: str) -> Column:
    """Rank from the largest, ties share the better rank, missing values have none."""
    return F.when(F.col(name).isNotNull(), F.rank().over(Window.partitionBy(*partition).orderBy(F.desc_nulls_last(name))))


def percent_rank_mean_ties(name: str, *partition: str) -> Column:
    """Share of values up to a row's, ties at the mean of their ranks; missing values have none."""
    groups = Window.partitionBy(*partition)
    rank = F.rank().over(groups.orderBy(F.asc_nulls_last(name)))
    ties = F.count(name).over(Window.partitionBy(*partition, name))
    return F.when(F.col(name).isNotNull(), (rank + (ties - 1) / 2) / F.count(name).over(groups))


def latest(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """The last row of each entity in ``order``."""
    row = F.row_number().over(Window.partitionBy(entity).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("_row", row).where("_row = 1").drop("_row")


def quantile_bins(df: DataFrame, name: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins with equal shares by exact interpolated quantiles, closed on the right; equal edges merge.

    The edges are one row, joined back.
    """
    edges = exact_quantiles(df, name, [i / bins for i in range(bins + 1)], out="_edges").select(F.coalesce("_edges", F.array().cast("array<double>")).alias("_edges"))
    inner = F.filter(F.array_distinct("_edges"), lambda e: (e > F.array_min("_edges")) & (e < F.array_max("_edges")))
    below = F.size(F.filter("_edges", lambda e: e < F.col(name)))
    return df.crossJoin(F.broadcast(edges.select(inner.alias("_edges")))).withColumn(out, F.when(F.col(name).isNotNull(), below)).drop("_edges")


def z_scores(df: DataFrame, signs: dict[str, int]) -> DataFrame:
    """``name_z`` for each column, by population deviation over all rows, times its sign, and their mean ``z``.

    Means and deviations are one aggregated row, not a window over everything.
    """
    df = cut(df)
    stats = df.agg(*[a for n in signs for a in (F.avg(n).alias(f"_{n}_m"), F.stddev_pop(n).alias(f"_{n}_s"))])
    out = df.crossJoin(F.broadcast(stats))
    z = {f"{n}_z": s * (F.col(n) - F.col(f"_{n}_m")) / F.nullif(F.col(f"_{n}_s"), F.lit(0.0)) for n, s in signs.items()}
    out = out.withColumns(z).select(*df.columns, *z)
    return out.withColumn("z", sum((F.col(c) for c in z), F.lit(0.0)) / len(z))


def trend_label(df: DataFrame, name: str, width: float = 0.75, out: str = "label") -> DataFrame:
    """HIGH and LOW beyond ``width`` sample deviations from the mean over all rows, else NORMAL."""
    rows = cut(df)
    stats = rows.agg(F.avg(name).alias("_m"), F.stddev_samp(name).alias("_s"))
    far = F.when(F.col(name) > F.col("_m") + width * F.col("_s"), "HIGH").when(F.col(name) < F.col("_m") - width * F.col("_s"), "LOW").otherwise("NORMAL")
    return rows.crossJoin(F.broadcast(stats)).withColumn(out, far).drop("_m", "_s")
