"""Two seasons of an entity blended into one set of inputs, tiered predictions and decomposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blend, shrink_two
from .panel import paired_seasons


def mid_season(panel: DataFrame, entity: str, season: str, prior: int, current: int, size: str, rates: Sequence[str], shrunk: Mapping[str, tuple[str, float, float]], other: Sequence[str] = (), least: int = 200) -> DataFrame:
    """One row an entity: ``cohort``, blended ``rates``, shrunken means and the newest of ``other``.

    ``size`` weighs the seasons. ``shrunk`` maps a mean to (its sample column, prior, strength). An entity
    with the current season alone needs ``least`` of ``size``; one-season entities are not shrunken.
    """
    sizes = [c for c, _, _ in shrunk.values()]
    names = list(dict.fromkeys([size, *rates, *shrunk, *sizes, *other]))
    pair = paired_seasons(panel, entity, season, prior, current, names)
    now, was = F.col(f"current_{size}"), F.col(f"prior_{size}")
    cohort = F.when(now.isNull(), "prior_only").when(was.isNotNull(), "blended").when(now >= least, "current_only")
    out = [F.col(entity), cohort.alias("cohort"), F.coalesce(now, F.lit(0)).alias(f"current_{size}"), F.coalesce(was, F.lit(0)).alias(f"prior_{size}")]
    out += [blend(F.col(f"current_{r}"), now, F.col(f"prior_{r}"), was).alias(r) for r in rates]
    for name, (n, prior_mean, strength) in shrunk.items():
        both = shrink_two(F.col(f"current_{name}"), F.col(f"current_{n}"), F.col(f"prior_{name}"), F.col(f"prior_{n}"), prior_mean, strength)
        out.append(F.when(F.col("cohort") == "blended", both).otherwise(F.coalesce(f"current_{name}", f"prior_{name}")).alias(name))
    newest = [F.coalesce(f"current_{o}", f"prior_{o}").alias(o) for o in other]
    return pair.withColumn("cohort", cohort).where("cohort is not null").select(*out, *newest)


def tiered(df: DataFrame, full: Column, base: Column, out: str = "pred") -> DataFrame:
    """The full model where its inputs are there, else the base model; ``tier`` says which."""
    tier = F.when(full.isNotNull(), "full").when(base.isNotNull(), "base")
    return df.withColumn(out, F.coalesce(full, base)).withColumn("tier", tier)


def decomposed(df: DataFrame, full: Column, rest: Column, volume: str, per_unit: float, pool: DataFrame | None = None) -> DataFrame:
    """``stuff``: the target without its volume part, at the pool's mean volume; ``premium``: what is beyond it."""
    mean = (df if pool is None else pool).agg(F.avg(volume).alias("_mean_volume"))
    out = df.crossJoin(F.broadcast(mean))
    return out.withColumn("stuff", rest + F.col("_mean_volume") * per_unit).withColumn("premium", full - F.col("stuff")).drop("_mean_volume")
