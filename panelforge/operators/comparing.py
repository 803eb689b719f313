"""Tables that compare models, formulas and predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCORES, correlation
from ..sources.tables import cut
from .linear import metrics
from .ranks import exact_quantiles
from .windows import quantile_bins, trend_label


def formula_sensitivity(configs: DataFrame, dataset: str = "dataset", r: str = "r", k: str = "k_bias", names: Sequence[str] | None = None) -> DataFrame:
    """Every configuration under every score formula, ranked within its dataset; ties share the better rank."""
    names = list(names or SCORES)
    scored = configs.withColumns({n: F.round(SCORES[n](F.col(r), F.col(k)), 5) for n in names})
    long = scored.unpivot([c for c in configs.columns], names, "formula", "score")
    rank = F.rank().over(Window.partitionBy(dataset, "formula").orderBy(F.desc_nulls_last("score")))
    return long.withColumn("rank", F.when(F.col("score").isNotNull(), rank))


def winners(sensitivity: DataFrame, config: str, dataset: str = "dataset") -> DataFrame:
    """The best configuration by dataset and formula, the first by name among equals."""
    best = F.min_by(F.struct("score", F.col(config).alias("winner")), F.struct(-F.col("score"), F.col(config)))
    return sensitivity.where(F.col("score").isNotNull()).groupBy(dataset, "formula").agg(best.alias("best")).select(dataset, "formula", "best.*")


def bias_by_bin(df: DataFrame, by: str, target: str, models: Sequence[str], bins: int = 5) -> DataFrame:
    """Mean of ``by`` and bias (observed less predicted) of each model in each quantile bin."""
    binned = quantile_bins(df, by, bins)
    long = binned.unpivot(["bin", by, target], list(models), "model", "pred").where(F.col("pred").isNotNull() & F.col("bin").isNotNull())
    return long.groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg(by).alias("mean_by"), F.avg(F.col(target) - F.col("pred")).alias("bias"))


def spot_check(df: DataFrame, target: str, old: str, new: str, by: str) -> DataFrame:
    """How two models differ: one row of delta statistics and of errors of both."""
    rows = cut(df.select(target, old, new, by).withColumn("_delta", F.col(new) - F.col(old)))
    delta = F.col("_delta")
    out = rows.agg(
        F.count(delta).alias("n"),
        F.avg(delta).alias("mean_delta"),
        F.stddev_samp(delta).alias("std_delta"),
        correlation(delta, F.col(by)).alias("delta_by_corr"),
        F.avg(F.abs(F.col(old) - F.col(target))).alias("mae_old"),
        F.avg(F.abs(F.col(new) - F.col(target))).alias("mae_new"),
        correlation(old, target).alias("r_old"),
        correlation(new, target).alias("r_new"),
        F.count_if(F.abs(delta) > 0.5).alias("movers"),
    )
    median = exact_quantiles(rows, "_delta", [0.5]).select(F.col("quantiles")[0].alias("median_delta"))
    return out.crossJoin(F.broadcast(median))


def side_by_side(outputs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Outputs of models on the keys of the first, each filled from the first where it lacks a key, and the differences from it.

    Each table has ``key``, once a row, and a column by its model's name.
    """
    (first, out), *rest = outputs.items()
    for _, df in rest:
        out = out.join(df, key, "left")
    filled = {name: F.coalesce(name, first) for name, _ in rest}
    return out.withColumns(filled).withColumns({f"{name}_delta": F.col(name) - F.col(first) for name, _ in rest})


def movers(df: DataFrame, by: str, key: str, old: str, new: str, top: int, least: float) -> DataFrame:
    """Of the ``top`` rows by ``by`` (ties by ``key``) those whose predictions differ by over ``least``, with the difference."""
    cohort = df.orderBy(F.desc_nulls_last(by), key).limit(top)
    return cohort.withColumn("delta", F.col(new) - F.col(old)).where(F.abs("delta") > least)


def predictor_table(df: DataFrame, predictors: Sequence[str], same: str, later: str, least: int = 30) -> DataFrame:
    """Correlation of each predictor with the same and with a later outcome, ranked by the same one, highest first."""
    long = df.unpivot([same, later], list(predictors), "metric", "value")
    both = F.when(F.col("value").isNotNull() & F.col(later).isNotNull(), 1)
    table = long.groupBy("metric").agg(
        F.count(F.when(F.col("value").isNotNull() & F.col(same).isNotNull(), 1)).alias("n_same"),
        correlation("value", same).alias("r_same"),
        F.count(both).alias("n_later"),
        correlation("value", later).alias("r_later"),
    )
    kept = table.where(F.col("n_same") >= least)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("r_same"), "metric")))


def best_predictors(table: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` metrics of a predictor table that have a correlation, with its sign."""
    return table.where(F.col("r_same").isNotNull() & (F.col("position") <= n)).select("metric", F.signum("r_same").alias("sign"))


def composite_trend(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], best: DataFrame, width: float = 0.75) -> DataFrame:
    """Mean of the signed z-scores of the metrics that ``best`` names, for rows that have all of them, with its label.

    ``best`` (metric, sign) is a result of the data, so the metrics are chosen inside the plan: rows are long, joined to
    it, and never pivoted. z-scores are by population deviation over the rows that count, the label by ``width`` sample deviations.
    """
    long = rows.unpivot(list(keys), list(metrics), "metric", "value").join(F.broadcast(best), "metric")
    wanted = best.agg(F.count("*").alias("_wanted"))
    full = long.groupBy(*keys).agg(F.count("value").alias("_have")).crossJoin(F.broadcast(wanted)).where("_have = _wanted and _wanted > 0").select(*keys)
    long = cut(long.join(full, list(keys)))
    stats = long.groupBy("metric").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.col("sign") * (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    score = long.join(F.broadcast(stats), "metric").groupBy(*keys).agg(F.avg(z).alias("score"))
    return trend_label(score, "score", width, "trend")


def ship_decision(df: DataFrame, target: str, old: str, new: str, name: Column, wanted: Mapping[str, float], slack: float = 0.005) -> DataFrame:
    """Whether a new model passes: its correlation is no more than ``slack`` under the old one's, and named entities exceed their marks.

    ``wanted`` maps part of a name to the mark that the first entity with it, by name, must exceed; an absent one fails.
    """
    named = [F.min_by(F.col(new), F.when(F.coalesce(name.contains(part), F.lit(False)), name)).alias(f"_{i}") for i, part in enumerate(wanted)]
    seen = df.agg(correlation(old, target).alias("r_old"), correlation(new, target).alias("r_new"), *named)
    ok = F.lit(True)
    for i, mark in enumerate(wanted.values()):
        ok = ok & F.coalesce(F.col(f"_{i}") > mark, F.lit(False))
    out = seen.withColumns({"pass_r": F.coalesce(F.col("r_new") >= F.col("r_old") - slack, F.lit(False)), "pass_named": ok})
    return out.select("r_old", "r_new", "pass_r", "pass_named", F.when(F.col("pass_r") & F.col("pass_named"), "PASS").otherwise("PARTIAL").alias("decision"))


def merge_guards(before: DataFrame, after: DataFrame, most_lost: float = 0.15) -> DataFrame:
    """Checks after a merge or a derivation: the share of rows lost, and how many values of doubles are infinite or NaN."""
    doubles = [c for c, t in after.dtypes if t == "double"]
    odd = F.lit(0).cast("long")
    for c in doubles:
        odd = odd + F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    n = after.agg(F.count("*").alias("_after"), odd.alias("odd")).crossJoin(F.broadcast(before.agg(F.count("*").alias("_before"))))
    lost = F.coalesce(1 - F.col("_after") / F.nullif(F.col("_before").cast("double"), F.lit(0.0)), F.lit(0.0))
    return checks(n.select(lost.alias("lost"), "odd"), {"lost": (-1e12, most_lost), "odd": (0, 0)})


def leaderboard(rows: DataFrame, formula: str = "linear_050", r: str = "r", k: str = "cohort_bias", incumbent: float | None = None, margin: float = 0.01) -> DataFrame:
    """Scored rows, best first, with the ship rule against an incumbent's score."""
    out = rows.withColumn("score", SCORES[formula](F.col(r), F.col(k)))
    if incumbent is not None:
        out = out.withColumn("ships", F.coalesce(F.col("score") - incumbent >= margin, F.lit(False)))
    return out.orderBy(F.desc_nulls_last("score"))


def checks(observed: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Quality guards over a one-row frame: a row a rule with what was seen, the range allowed, and whether it holds."""
    long = observed.select(*[F.col(c).cast("double").alias(c) for c in rules]).unpivot([], list(rules), "check", "observed")
    low: Column = F.lit(None).cast("double")
    high: Column = F.lit(None).cast("double")
    for name, (a, b) in rules.items():
        low = F.when(F.col("check") == name, F.lit(float(a))).otherwise(low)
        high = F.when(F.col("check") == name, F.lit(float(b))).otherwise(high)
    out = long.withColumn("least", low).withColumn("most", high)
    return out.withColumn("passed", F.coalesce(F.col("observed").between(F.col("least"), F.col("most")), F.lit(False)))


def stability(pairs: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Correlation of each metric with itself a season later and with the target."""
    each = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("now"), F.col(f"next_{n}").alias("then")) for n in names]
    long = pairs.select(F.col(target).alias("_target"), F.explode(F.array(*each)).alias("m")).select("_target", "m.*")
    return long.groupBy("metric").agg(correlation("now", "then").alias("stability"), correlation("now", "_target").alias("target_r"))


def evaluate(df: DataFrame, target: str, models: Sequence[str], cohort: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The metrics of several prediction columns in one grouping."""
    ids = [target, *keys] + (["_cohort"] if cohort is not None else [])
    rows = df.withColumn("_cohort", cohort) if cohort is not None else df
    long = rows.unpivot(ids, list(models), "model", "_pred").where(F.col("_pred").isNotNull() & F.col(target).isNotNull())
    return long.groupBy("model", *keys).agg(*metrics(target, "_pred", F.col("_cohort") if cohort is not None else None))
