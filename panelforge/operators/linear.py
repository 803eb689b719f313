"""Ridge regression and its evaluation from moments that Spark sums in one pass.

A pass over rows gives, for every fold or season, the sums that all fits need; a fit on any union of
folds, any penalty and any subset of the features is then algebra on a few small matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import correlation

ALPHAS = np.logspace(-1, 5, 80)


@dataclass
class Moments:
    """Count, means and centred products of (features…, target) over some rows."""

    n: float
    mean: np.ndarray
    centred: np.ndarray
    names: list[str]

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        return Moments(n, mean, self.centred + other.centred + np.outer(gap, gap) * (self.n * other.n / n), self.names)

    def only(self, features: Sequence[str]) -> Moments:
        """The moments of some of the features and the target, from the same rows."""
        at = [self.names.index(f) for f in features] + [len(self.names)]
        return Moments(self.n, self.mean[at], self.centred[np.ix_(at, at)], list(features))


@dataclass
class Fit:
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    alpha: float
    standardized: np.ndarray

    def predict(self) -> Column:
        """The prediction as a column; NULL where a feature is missing."""
        out = F.lit(float(self.intercept))
        for f, c in zip(self.features, self.coefficients):
            out = out + F.col(f) * F.lit(float(c))
        return out


def key_fold(folds: int, first: str, second: str) -> Column:
    """A fold from two whole-number keys by arithmetic, the same whatever the row order."""
    return F.pmod(F.col(first) * 31 + F.col(second), F.lit(folds)).cast("int")


def hash_fold(folds: int, *keys: str, seed: int = 42) -> Column:
    """A fold from the keys alone, the same whatever the row order."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int")


def moments(df: DataFrame, features: Sequence[str], target: str, by: str | Column = None) -> dict:
    """Moments of the complete rows, by fold or season, from one job.

    Spark merges centred sums of its partitions (``avg``, ``covar_pop``), so nothing cancels and no pass for
    the means comes first.
    """
    return moments_of(df, features, [target], by)[target]


def moments_of(df: DataFrame, features: Sequence[str], targets: Sequence[str], by: str | Column = None) -> dict[str, dict]:
    """The moments with each of several targets from one job over the rows in which all of them are there."""
    names = [*features, *targets]
    rows = df.na.drop(subset=names)
    p = len(features)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names)) if i < p or i == j]
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]
    sums += [F.covar_pop(names[i], names[j]).alias(f"p{i}_{j}") for i, j in pairs]
    key = F.lit(0) if by is None else (F.col(by) if isinstance(by, str) else by)
    out: dict[str, dict] = {t: {} for t in targets}
    for r in rows.groupBy(key.alias("_by")).agg(F.count("*").alias("n"), *sums).collect():
        n = float(r["n"])
        for k, t in enumerate(targets, start=p):
            at = [*range(p), k]
            centred = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in at] for i in at]) * n
            out[t][r["_by"]] = Moments(n, np.array([r[f"m{i}"] for i in at]), centred, list(features))
    return out


def total(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


def solve(m: Moments, alpha: float, scale: np.ndarray | None = None) -> Fit:
    """Ridge on features standardized by population deviation; a constant feature has no weight."""
    p = len(m.names)
    sigma = np.sqrt(np.diag(m.centred)[:p] / m.n) if scale is None else scale
    safe = np.where(sigma > 1e-12 * np.maximum(1, np.abs(m.mean[:p])), sigma, np.inf)
    a = m.centred[:p, :p] / np.outer(safe, safe)
    b = m.centred[:p, p] / safe
    w = np.linalg.solve(a + alpha * np.eye(p), b)
    c = w / safe
    return Fit(list(m.names), c, float(m.mean[p] - c @ m.mean[:p]), float(alpha), w)


def _r2(fit: Fit, m: Moments) -> float:
    p = len(fit.features)
    c = fit.coefficients
    gap = m.mean[p] - fit.intercept - c @ m.mean[:p]
    residual = m.centred[p, p] - 2 * c @ m.centred[:p, p] + c @ m.centred[:p, :p] @ c + m.n * gap**2
    return 1 - residual / m.centred[p, p] if m.centred[p, p] > 0 else 0.0


def fold_scores(folds: dict, alphas: Sequence[float] = ALPHAS) -> np.ndarray:
    """Mean R² over held-out folds for each penalty; features are scaled by all rows.

    One decomposition a fold serves all penalties.
    """
    parts = [folds[k] for k in sorted(folds)]
    whole = total(parts)
    p = len(whole.names)
    scale, alphas = np.sqrt(np.diag(whole.centred)[:p] / whole.n), np.asarray(alphas, dtype=float)
    out = np.zeros((len(parts), len(alphas)))
    for i, held in enumerate(parts):
        rest = total([m for j, m in enumerate(parts) if j != i])
        safe = np.where(scale > 1e-12 * np.maximum(1, np.abs(rest.mean[:p])), scale, np.inf)
        values, vectors = np.linalg.eigh(rest.centred[:p, :p] / np.outer(safe, safe))
        along = vectors.T @ (rest.centred[:p, p] / safe)
        c = vectors @ (along[:, None] / (np.maximum(values, 0)[:, None] + alphas)) / safe[:, None]
        gap = held.mean[p] - rest.mean[p] - (held.mean[:p] - rest.mean[:p]) @ c
        residual = held.centred[p, p] - 2 * held.centred[:p, p] @ c + (c * (held.centred[:p, :p] @ c)).sum(axis=0) + held.n * gap**2
        if held.centred[p, p] > 0:
            out[i] = 1 - residual / held.centred[p, p]
    return out.mean(axis=0)


def ridge_search(folds: dict, alphas: Sequence[float] = ALPHAS) -> Fit:
    """The fit on all folds with the penalty of the best mean R²; the smallest among equals, which are so to 12 decimals.

    On many rows neighbouring penalties differ by less than sums in another order do.
    """
    scores = fold_scores(folds, alphas).round(12)
    return solve(total(list(folds.values())), float(alphas[int(scores.argmax())]))


def k_fold_score(folds: dict) -> float:
    """Root of the mean R² over folds, 0 for a negative one; the penalty of each is chosen on the other folds alone."""
    scores = []
    for held in sorted(folds):
        rest = {k: m for k, m in folds.items() if k != held}
        scores.append(_r2(ridge_search(rest) if len(rest) > 1 else solve(total(list(rest.values())), 1.0), folds[held]))
    return float(np.sqrt(max(0.0, float(np.mean(scores)))))


def metrics(target: str, pred: str, cohort: Column | None = None) -> list[Column]:
    """Correlation, errors and biases of a prediction, overall and within a cohort, as aggregates.

    A bias is the mean of what is observed less what was predicted.
    """
    miss = F.col(target) - F.col(pred)
    out = [F.count(miss).alias("n"), correlation(pred, target).alias("r"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"), F.avg(miss).alias("bias")]
    return out + ([F.avg(F.when(cohort, miss)).alias("cohort_bias")] if cohort is not None else [])


def with_pooled(df: DataFrame, by: str, aggregates: Sequence[Column], target: str, pred: str) -> DataFrame:
    """The aggregates by ``by``, with ``pooled_r``, the correlation over all rows together, in every row."""
    return df.groupBy(by).agg(*aggregates).crossJoin(F.broadcast(df.agg(correlation(pred, target).alias("pooled_r"))))


def coefficient_table(spark, fits: dict, key: str = "held_out", kind: str = "int") -> DataFrame:
    """Fits as rows: one a held-out season, of which there are few."""
    rows = [(k, f.intercept, f.alpha, [float(c) for c in f.coefficients]) for k, f in sorted(fits.items())]
    return spark.createDataFrame(rows, f"{key} {kind}, intercept double, alpha double, coefficients array<double>")


def predict_by(df: DataFrame, table: DataFrame, key: str, season: Column, features: Sequence[str], out: str = "pred") -> DataFrame:
    """Predictions by the fit that belongs to a row's season."""
    joined = df.withColumn(key, season.cast(table.schema[key].dataType)).join(F.broadcast(table), key)
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefficients")[i] * F.col(f)
    return joined.withColumn(out, pred).drop("intercept", "alpha", "coefficients")


def held_out_fits(by_season: dict, mode: str = "leave_one_out", alpha: float | None = None, least_rows: int = 50) -> dict:
    """A fit for each season from all others, or from the earlier ones only (``past_only``)."""
    out = {}
    for season in sorted(by_season):
        others = {s: m for s, m in by_season.items() if (s != season if mode == "leave_one_out" else s < season)}
        if others and sum(m.n for m in others.values()) >= least_rows:
            out[season] = ridge_search(others) if alpha is None and len(others) > 1 else solve(total(list(others.values())), alpha or 1.0)
    return out


def out_of_season(df: DataFrame, features: Sequence[str], target: str, season: str = "season", alpha: float | None = None) -> DataFrame:
    """Rows with ``pred`` from models that never saw their season."""
    fits = held_out_fits(moments(df, features, target, season), alpha=alpha)
    table = coefficient_table(df.sparkSession, fits)
    return predict_by(df.na.drop(subset=[*features, target]), table, "held_out", F.col(season), features)


def cross_season(pairs: DataFrame, panel: DataFrame, features: Sequence[str], target: str, season: str = "season", alpha: float | None = None, least_rows: int = 50) -> DataFrame:
    """Next season's target predicted from this season's features, by models of the seasons before it.

    ``pairs`` come from ``lag_join``; the model for ``to_season`` is fitted on panel seasons before it.
    """
    fits = held_out_fits(moments(panel, features, target, season), mode="past_only", alpha=alpha, least_rows=least_rows)
    table = coefficient_table(panel.sparkSession, fits)
    return predict_by(pairs.na.drop(subset=[*features, f"next_{target}"]), table, "held_out", F.col("to_season"), features)


def season_residual(df: DataFrame, features: Sequence[str], target: str, season: str = "season", mode: str = "leave_one_out", out: str = "residual", alpha: float | None = None) -> DataFrame:
    """What a season's value has beyond the prediction of a model fitted on other seasons; NULL where none is."""
    fits = held_out_fits(moments(df, features, target, season), mode=mode, alpha=alpha)
    table = coefficient_table(df.sparkSession, fits).withColumnRenamed("held_out", season)
    joined = df.join(F.broadcast(table), season, "left")
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefficients")[i] * F.col(f)
    return joined.withColumn(out, F.col(target) - pred).drop("intercept", "alpha", "coefficients")


def screen(folds: dict, base: Sequence[str], candidates: Sequence[str]) -> list[tuple[str, str, float, float]]:
    """Forward screen: each candidate added to the base set. Rows of kind, feature, score, gain."""
    start = k_fold_score({k: m.only(base) for k, m in folds.items()})
    out = [("base", "", start, 0.0)]
    for c in candidates:
        score = k_fold_score({k: m.only([*base, c]) for k, m in folds.items()})
        out.append(("add", c, score, score - start))
    return out


def replacements(folds: dict, base: Sequence[str], candidates: Sequence[str]) -> list[tuple[str, str, float, float]]:
    """Each feature of the base set swapped for each candidate. Rows of kind, ``old>new``, score, gain."""
    start = k_fold_score({k: m.only(base) for k, m in folds.items()})
    out = []
    for old in base:
        for new in candidates:
            if new not in base:
                score = k_fold_score({k: m.only([new if f == old else f for f in base]) for k, m in folds.items()})
                out.append(("swap", f"{old}>{new}", score, score - start))
    return out


def eliminate(folds: dict, features: Sequence[str], least: int = 2) -> list[tuple[int, str, float]]:
    """Backward elimination by the smallest absolute standardized coefficient: step, features, score."""
    left, out = list(features), []
    while True:
        own = {k: m.only(left) for k, m in folds.items()}
        fit = ridge_search(own)
        out.append((len(features) - len(left), ",".join(left), k_fold_score(own)))
        if len(left) <= least:
            return out
        left.pop(int(np.abs(fit.standardized).argmin()))
