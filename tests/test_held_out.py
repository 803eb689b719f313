"""Evaluation from cells of moments against fits on the rows themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import held_out as H
from panelforge.operators.linear import ALPHAS, key_fold

FEATURES = ["a", "b", "c", "d"]


def panel(seed=0, entities=40, seasons=6):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        level = rng.normal()
        for s in range(seasons):
            if rng.random() < 0.15:
                continue  # a gap in the seasons
            x = rng.normal(level, 1, 4)
            y = 2 * x[0] - x[1] + 0.3 * x[2] + rng.normal(0, 0.5) if rng.random() > 0.05 else np.nan
            x[1] = np.nan if rng.random() < 0.2 else x[1]
            x[3] = np.nan if rng.random() < 0.3 else x[3]
            out.append((e, 2000 + s, *x, y))
    return pd.DataFrame(out, columns=["entity", "season", *FEATURES, "y"])


def frame(spark, data):
    rows = [(int(r[0]), int(r[1]), *[None if np.isnan(v) else float(v) for v in r[2:]]) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "entity long, season int, a double, b double, c double, d double, y double").repartition(4)


def fitted(train, features, alpha):
    """Ridge on rows: penalty by five folds with scaling by all rows, the smallest among equals."""
    x, y = train[features].to_numpy(), train.y.to_numpy()
    sd, fold = x.std(axis=0), ((train.entity * 31 + train.season) % 5).to_numpy()
    sd = np.where(sd > 0, sd, np.inf)

    def solve(x, y, alpha):
        m, z = x.mean(axis=0), (x - x.mean(axis=0)) / sd
        c = np.linalg.solve(z.T @ z + alpha * np.eye(len(sd)), z.T @ (y - y.mean())) / sd
        return lambda q: y.mean() + (q - m) @ c, c * sd

    if alpha is None:
        scores = []
        for a in ALPHAS:
            own = []
            for k in sorted(set(fold)):
                f, _ = solve(x[fold != k], y[fold != k], a)
                t = y[fold == k]
                own.append(1 - ((t - f(x[fold == k])) ** 2).sum() / ((t - t.mean()) ** 2).sum())
            scores.append(np.mean(own))
        alpha = ALPHAS[int(np.argmax(scores))]
    return (*solve(x, y, alpha), alpha)


def plain(data, features, ahead, alpha=None, least_test=10, least_train=50):
    pairs = data.merge(data.assign(season=data.season - 1)[["entity", "season", "y", "a"]], on=["entity", "season"], suffixes=("", "_next"))
    out, preds = [], []
    for s in sorted(data.season.unique()):
        train = data[(data.season < s) if ahead else (data.season != s)].dropna(subset=[*features, "y"])
        if ahead:
            test = pairs[pairs.season == s - 1].dropna(subset=[*features, "y_next"])
            y, k = test.y_next.to_numpy(), test.a_next.to_numpy()
        else:
            test = data[data.season == s].dropna(subset=[*features, "y"])
            y, k = test.y.to_numpy(), test.a.to_numpy()
        if len(test) < least_test or len(train) < least_train:
            continue
        f, _, own = fitted(train, features, alpha)
        p = f(test[features].to_numpy())
        preds.append((p, y, k))
        out.append((s, own, p, y, k))
    out.append((None, None, *(np.concatenate(z) for z in zip(*preds))))
    return [(s, a, len(y), np.corrcoef(p, y)[0, 1], np.sqrt(np.mean((y - p) ** 2)), np.mean(y - p), np.mean((y - p)[k > 0.5])) for s, a, p, y, k in out]


@pytest.fixture(scope="module")
def data(spark):
    d = panel()
    return d, H.cells(frame(spark, d), FEATURES, "y", cohorts={"hi": F.col("a") > 0.5}, fold=key_fold(5, "entity", "season"))


@pytest.mark.parametrize("mode", ["out_of_season", "cross_season"])
@pytest.mark.parametrize("features, alpha", [(["a"], 1.0), (["a", "b", "c"], None), (FEATURES, None), (["c", "a"], 30.0)])
def test_evaluation(data, mode, features, alpha):
    rows, cells = data
    got = H.evaluate(cells, features, mode, alpha)
    want = plain(rows, features, mode == "cross_season", alpha)
    assert [(r["season"], r["n"]) for r in got] == [(w[0], w[2]) for w in want]
    for r, w in zip(got, want):
        assert np.allclose([r["r"], r["rmse"], r["bias"], r["bias_hi"]], w[3:], atol=1e-9)
        assert r["alpha"] is None or np.isclose(r["alpha"], w[1])


def test_guards(data):
    rows, cells = data
    assert [r["season"] for r in H.evaluate(cells, ["a"], "cross_season", least_train=10**6)] == [None]
    assert H.evaluate(cells, ["a"], "cross_season", least_train=10**6)[-1]["r"] is None
    assert [r["season"] for r in H.evaluate(cells, ["a"], least_test=34)] == [w[0] for w in plain(rows, ["a"], False, least_test=34)]


@pytest.mark.parametrize("least_features, least_rows", [(0, 1), (2, 1), (0, 140)])
def test_elimination(data, least_features, least_rows):
    rows, cells = data
    left, want = list(FEATURES), []
    while len(left) > least_features and len(rows.dropna(subset=[*left, "y"])) >= least_rows:
        complete = rows.dropna(subset=[*left, "y"])
        _, weights, _ = fitted(complete, left, None)
        r = plain(rows, left, True)[-1][3]
        dropped = left[int(np.abs(weights).argmin())]
        want.append((",".join(left), len(complete), dropped, r))
        left.remove(dropped)
    got = H.eliminate(cells, FEATURES, lambda r: r["r"], least_features, least_rows)
    assert [(r["features"], r["n_rows"], r["dropped"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r["score"] for r in got], [w[3] for w in want])
    assert [r["step"] for r in got if r["best"]] == ([int(np.argmax([w[3] for w in want]))] if want else [])


def test_one_scan(spark, small):
    """Cells come from one aggregate over one scan of the events."""
    from panelforge.queries.base import panel as season_panel

    seen = []
    own = type(spark.range(1)).collect

    def collect(self):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return own(self)

    try:
        type(spark.range(1)).collect = collect
        H.cells(season_panel(spark, small), ["k_pct", "swing_pct"], "target")
    finally:
        type(spark.range(1)).collect = own
    assert len(seen) == 1 and seen[0].count("FileScan parquet") == 1


def test_empty_panel(spark):
    cells = H.cells(frame(spark, panel().head(0)), FEATURES, "y")
    assert H.evaluate(cells, ["a"])[-1]["n"] == 0 and H.eliminate(cells, FEATURES, lambda r: r["r"]) == []


def test_trees_fit_once_on_a_partition_a_core(spark, monkeypatch):
    """However many shuffle partitions there are, a fit has a task a core, and equal training seasons share one fit."""
    from panelforge.operators import trees as T

    seen = []

    class Mean:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(1.0))

    d = panel().dropna(subset=["a", "y"])
    monkeypatch.setitem(T.MODELS, "mean", lambda trees: Mean())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = T.held_out(frame(spark, d), ["a"], "y", [2004, 2005], {"mean": 1})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    n = {s: int((d.season < s).sum()) for s in (2004, 2005)}
    assert sorted(seen) == sorted((spark.sparkContext.defaultParallelism, m) for m in (n[2004], n[2005], int((d.season != 2004).sum())))
    now = d[d.season.isin([2004, 2005])]
    pairs = d.assign(season=d.season + 1).merge(d, on=["entity", "season"], suffixes=("_before", ""))
    assert [(r["mode"], r["n"]) for r in rows] == [("out_of_season", len(now)), ("cross_season", int(pairs.season.isin([2004, 2005]).sum()))]
