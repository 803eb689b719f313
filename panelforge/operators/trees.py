"""Tree ensembles from Spark ML beside the linear models, importance by permutation, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .held_out import told
from .linear import Moments, hash_fold, total

MODELS = {
    "forest": lambda trees: RandomForestRegressor(labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=5, minInstancesPerNode=5, seed=42),
    "boosted": lambda trees: GBTRegressor(labelCol="_y", featuresCol="_x", maxIter=trees, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=42),
}


def fit_trees(rows: DataFrame, features: Sequence[str], target: str, kind: str, trees: int = 20):
    """A fitted ensemble over complete rows."""
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.na.drop(subset=[*features, target]))
    return MODELS[kind](trees).fit(ready.withColumn("_y", F.col(target).cast("double")).select("_x", "_y"))


def predict_trees(model, rows: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.na.drop(subset=list(features)))
    return model.transform(ready).withColumnRenamed("prediction", out).drop("_x")


def gap_class(r_trees: float, r_linear: float) -> str:
    """How far an ensemble is ahead of the linear model."""
    gap = r_trees - r_linear
    return "none" if gap < 0.003 else "small" if gap < 0.010 else "large"


def permutation_importance(model, rows: DataFrame, features: Sequence[str], target: str, seed: int = 7) -> DataFrame:
    """Rise of the mean squared error when one feature's values are dealt anew over the rows; the model scores once.

    A feature's values change places along a hashed order of rows: each takes the value of the next row
    within its hash group, so nothing is gathered in one task. Every row is replicated, once as it is and once a feature
    with that value changed, and all replicas are scored together and grouped by feature.
    """
    rows = rows.na.drop(subset=[*features, target]).withColumn("_h", F.xxhash64(*features, F.lit(seed)))
    groups = Window.partitionBy(F.pmod("_h", F.lit(64))).orderBy("_h")
    plain = [F.col(f).cast("double") for f in features]
    moved = [F.coalesce(F.lead(f).over(groups), F.first(f).over(groups)).cast("double") for f in features]
    both = rows.select(F.col(target).alias("_t"), F.array(*plain).alias("_plain"), F.array(*moved).alias("_moved"))
    replicas = F.array(F.struct(F.lit("").alias("feature"), F.col("_plain").alias("_values")), *[F.struct(F.lit(f).alias("feature"), F.concat(F.slice("_plain", 1, i), F.slice("_moved", i + 1, 1), F.slice("_plain", i + 2, len(features))).alias("_values")) for i, f in enumerate(features)])
    long = both.select("_t", F.explode(replicas).alias("_r")).select("_t", "_r.feature", array_to_vector("_r._values").alias("_x"))
    errors = model.transform(long).groupBy("feature").agg(F.avg((F.col("prediction") - F.col("_t")) ** 2).alias("mse"))
    base = errors.agg(F.max(F.when(F.col("feature") == "", F.col("mse"))).alias("base"), F.collect_list(F.struct("feature", "mse")).alias("all"))
    return base.select("base", F.inline("all")).where("feature <> ''").select("feature", (F.col("mse") - F.col("base")).alias("importance"))


def held_out(panel: DataFrame, features: Sequence[str], target: str, seasons: Sequence[int], trees: Mapping[str, int], entity: str = "entity", season: str = "season", cohort: Column | None = None, least_test: int = 10, least_train: int = 50, at_once: int = 4) -> list[dict]:
    """Ensembles under both evaluations of ``held_out.evaluate``: a row a (mode, kind) with its pooled metrics.

    Rows are assembled once into one cached table, which every fit filters, in as many partitions as there are cores: each of
    an ensemble's hundreds of jobs runs a task a partition. Fits run as concurrent Spark jobs, ``at_once`` at a time; seasons to
    predict from the same training seasons share one. Predictions come back as moments, not as rows.
    """
    partitions = panel.sparkSession.sparkContext.defaultParallelism
    w = Window.partitionBy(entity).orderBy(season)
    flag = F.coalesce(cohort, F.lit(False)) if cohort is not None else F.lit(False)
    follows = F.lead(season).over(w) == F.col(season) + 1
    rows = panel.select(entity, season, *features, F.col(target).cast("double").alias("_y"), flag.alias("_c")).repartition(partitions, entity)
    rows = rows.withColumns({"_z": F.when(follows, F.lead("_y").over(w)), "_d": F.when(follows, F.lead("_c").over(w)).otherwise(False)})
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.na.drop(subset=list(features))).select(F.col(season).alias("_s"), "_x", "_y", "_z", "_c", "_d").persist()
    try:
        sizes = {r["_s"]: r for r in ready.groupBy("_s").agg(F.count("_y").alias("y"), F.count("_z").alias("z")).collect()}

        def inside(mode: str, s: int) -> tuple[int, ...]:
            return tuple(sorted(k for k in sizes if (k < s if mode == "cross_season" else k != s)))

        def scored(model, mode: str, s: int) -> dict[bool, Moments]:
            ahead = mode == "cross_season"
            y, c = ("_z", "_d") if ahead else ("_y", "_c")
            test = ready.where((F.col("_s") == (s - 1 if ahead else s)) & F.col(y).isNotNull())
            pairs = (("prediction", "prediction"), ("prediction", y), (y, y))
            sums = [F.count("*").alias("n"), F.avg("prediction").alias("mp"), F.avg(y).alias("my"), *[F.covar_pop(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)]]
            out = {}
            for r in model.transform(test).groupBy(F.col(c).alias("c")).agg(*sums).collect():
                out[r["c"]] = Moments(float(r["n"]), np.array([r["mp"], r["my"]]), np.array([[r["v0"], r["v1"]], [r["v1"], r["v2"]]]) * r["n"], ["pred"])
            return out

        def one(task: tuple[str, tuple[int, ...]]):
            kind, seasons_in = task
            model = MODELS[kind](trees[kind]).fit(ready.where(F.col("_s").isin(*seasons_in) & F.col("_y").isNotNull()).select("_x", "_y"))
            return [((mode, kind, s), scored(model, mode, s)) for mode, s in tests[seasons_in]]

        tests: dict[tuple[int, ...], list[tuple[str, int]]] = {}
        for mode in ("out_of_season", "cross_season"):
            for s in seasons:
                own = inside(mode, s)
                n_test = sizes[s - 1]["z"] if mode == "cross_season" and s - 1 in sizes else sizes[s]["y"] if mode != "cross_season" and s in sizes else 0
                if n_test >= least_test and sum(sizes[k]["y"] for k in own) >= least_train:
                    tests.setdefault(own, []).append((mode, s))
        with ThreadPoolExecutor(at_once) as pool:
            found = [f for fs in pool.map(one, [(k, own) for own in tests for k in trees]) for f in fs]
    finally:
        ready.unpersist()
    out = []
    for mode in ("out_of_season", "cross_season"):
        for kind in trees:
            own = [(c, m) for (o, k, _), cells in found if (o, k) == (mode, kind) for c, m in cells.items()]
            high = [m for c, m in own if c]
            out.append({"mode": mode, "model": kind, "trees": trees[kind], **told(total([m for _, m in own]) if own else None), "bias_hi": told(total(high) if high else None)["bias"]})
    return out


def out_of_fold(rows: DataFrame, features: Sequence[str], target: str, kinds: Sequence[str], keys: Sequence[str], folds: int = 2, trees: int = 10) -> DataFrame:
    """Rows with a column of out-of-fold predictions a kind, the inputs of a stacked model."""
    rows = rows.na.drop(subset=[*features, target]).withColumn("_fold", hash_fold(folds, *keys))
    out = None
    for k in range(folds):
        part = rows.where(F.col("_fold") == k)
        for kind in kinds:
            part = predict_trees(fit_trees(rows.where(F.col("_fold") != k), features, target, kind, trees), part, features, kind)
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")
