"""Operators on small inline frames: missing values, zero denominators, ties, gaps, golden values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as C
from panelforge.operators import blending as B
from panelforge.operators import comparing as K
from panelforge.operators import linear as L
from panelforge.operators import panel as P
from panelforge.operators import windows as W
from panelforge.sources import tables as R


def values(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_safe_ratio_and_flags(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 4, "x"), (None, 2, "y")], "a int, b int, c string")
    got = df.select(C.safe_ratio("a", "b").alias("r"), C.flag(F.col("c") == "x").alias("f")).collect()
    assert [tuple(r) for r in got] == [(None, False), (0.25, True), (None, False)]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.clip_lower("x", 0.0)).collect()] == [0.0, 2.0, None]


def test_scoring_rule_and_shrinkage(spark):
    row = spark.createDataFrame([(2, 3.0, 3, 1, 2, 0)], "k int, ip double, h int, er int, bb int, hbp int")
    score = C.weighted_score({"k": 1, "ip": 3.3, "h": -1, "er": -2, "bb": -1, "hbp": -1})
    shrunk = C.shrink(F.lit(0.411), F.lit(28), 0.3117, 40)
    got = row.select(score.alias("a"), shrunk.alias("b")).first()
    assert got["a"] == pytest.approx(4.9) and got["b"] == pytest.approx(0.35259, abs=1e-5)


def test_score_formulas(spark):
    row = spark.createDataFrame([(0.6, 0.466)], "r double, k double")
    got = row.select(*[f(F.col("r"), F.col("k")).alias(n) for n, f in C.SCORES.items()]).first()
    assert got["linear_050"] == pytest.approx(1.567)
    assert got["tolerance_100"] == pytest.approx(1.8)
    assert got["quadratic_050"] == pytest.approx(1.69142, abs=1e-5)


def test_approach_angle_without_arrival(spark):
    row = spark.range(1).select(C.approach_angle(F.lit(-1.0), F.lit(0.0), F.lit(50.0), F.lit(-30.0), F.lit(6.0)).alias("a"))
    assert row.first()["a"] is None


def test_rescale_mixed_columns(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.3, 40.0), (None, None)], "a_pct double, b_pct double")
    assert [tuple(r) for r in C.rescale_percents(df).collect()] == [(10.0, 0.5), (30.0, 40.0), (None, None)]


def test_rolling_stays_within_entity(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 10.0), (2, 2, 20.0), (2, 3, 30.0)], "e int, t int, x double")
    got = df.withColumn("m", W.rolling_mean("x", "e", ["t"], 5, 2))
    assert values(got, "m", "e", "t") == [None, None, 1.5, None, None, 15.0]


def test_lags_over_a_gap(spark):
    df = spark.createDataFrame([(1, 2015, 1.0), (1, 2017, 3.0)], "e int, s int, x double")
    assert values(W.lags(df, "e", ["s"], ["x"]), "x_lag1", "s") == [None, 1.0]


def test_percent_rank_and_bins(spark):
    df = spark.createDataFrame([(None,), (5.0,), (1.0,), (9.0,)], "x double")
    got = df.withColumn("p", W.percent_rank_mean_ties("x"))
    assert values(got, "p", "x") == [None, pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0]
    seven = spark.createDataFrame([(float(i),) for i in range(1, 8)], "x double")
    assert values(W.quantile_bins(seven, "x", 5), "bin", "x") == [0, 0, 1, 2, 3, 4, 4]
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    assert values(W.quantile_bins(flat, "x", 5), "bin", "x") == [0, 0, 0]


def test_starters_by_explicit_order(spark):
    df = spark.createDataFrame([(1, "a", 7, 2), (1, "a", 8, 1), (1, "b", 7, 3)], "g int, side string, e int, seq int")
    assert sorted(values(P.starters(df, ["g", "side"], "e", ["seq"]), "e", "e")) == [7, 8]


def test_blend_of_one_side(spark):
    df = spark.createDataFrame([(1, 2000, 100, 0.2, None), (1, 2001, 300, 0.4, 1.0), (2, 2001, 199, 0.5, 1.0), (3, 2001, 200, 0.5, 1.0), (4, 2000, 10, 0.1, 2.0)], "e int, season int, n int, r double, x double")
    got = {r["e"]: r for r in B.mid_season(df, "e", "season", 2000, 2001, "n", ["r"], {"x": ("n", 0.5, 40.0)}).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1]["cohort"] == "blended" and got[1]["r"] == pytest.approx(0.35)
    assert got[1]["x"] == pytest.approx((100 * 0.5 + 300 * 1.0 + 40 * 0.5) / 440)
    assert got[3]["cohort"] == "current_only" and got[4]["x"] == 2.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 1000, 5]
    y = x @ [1.0, 0.05, 3.0] + rng.normal(size=300)
    data = [(i, int(i % 5), *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id int, season int, a double, b double, c double, flat double, y double")


def test_moments_add_up(rows):
    _, _, df = rows
    by = L.moments(df, ["a", "b", "c"], "y", "season")
    whole, all_ = L.total(list(by.values())), L.moments(df, ["a", "b", "c"], "y")[0]
    assert whole.n == all_.n and np.allclose(whole.centred, all_.centred) and np.allclose(whole.mean, all_.mean)


def test_ridge_is_the_closed_form(rows):
    x, y, df = rows
    fit = L.solve(L.moments(df, ["a", "b", "c"], "y")[0], 5.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(fit.standardized, w, atol=1e-8)
    least = L.solve(L.moments(df, ["a", "b", "c"], "y")[0], 1e-12)
    ols = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)[0]
    assert np.allclose(least.coefficients, ols[:3], atol=1e-5) and least.intercept == pytest.approx(ols[3], abs=1e-2)


def test_fold_scores_match_rows(rows):
    x, y, df = rows
    folds = L.moments(df, ["a", "b", "c"], "y", "season")
    got = L.fold_scores(folds, [0.1, 10.0])
    s = x.std(0)
    want = []
    for alpha in (0.1, 10.0):
        r2 = []
        for k in range(5):
            held = np.arange(300) % 5 == k
            m, t = x[~held].mean(0), y[~held].mean()
            z = (x[~held] - m) / s
            w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[~held] - t))
            p = (x[held] - m) / s @ w + t
            r2.append(1 - ((y[held] - p) ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
        want.append(np.mean(r2))
    assert np.allclose(got, want, atol=1e-9)


def test_constant_feature_and_missing_rows(rows, spark):
    _, _, df = rows
    assert L.solve(L.moments(df, ["a", "flat"], "y")[0], 1.0).coefficients[1] == 0
    assert L.moments(df.where("id < 0"), ["a"], "y") == {}


def test_partitioning_does_not_matter(rows):
    _, _, df = rows
    a, b = (L.ridge_search(L.moments(df.repartition(n), ["a", "b"], "y", "season")) for n in (1, 8))
    assert a.alpha == b.alpha and np.allclose(a.coefficients, b.coefficients)


def test_formula_ranks_and_ties(spark):
    df = spark.createDataFrame([("x", "d", 0.6, 0.4), ("y", "d", 0.6, -0.4), ("z", "d", 0.5, 0.1), ("w", "d", None, 0.1)], "config string, dataset string, r double, k_bias double")
    out = K.formula_sensitivity(df, names=["linear_050"])
    assert values(out, "rank", "config") == [None, 1, 1, 3]
    assert K.winners(out, "config").first()["winner"] == "x"


def test_fallback_and_schema(spark, tmp_path):
    new, old = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(1, 9.0), (2, 3.0)], "k int, v double")
    assert values(P.with_fallback(new, old, ["k"]), "v", "k") == [2.0, 3.0]
    df = spark.createDataFrame([(float("nan"), "x")], "a double, b string")
    got = R.with_schema(df, R.T.StructType.fromDDL("b string, a double, c int"))
    assert got.columns == ["b", "a", "c"] and got.first()["a"] is None
    assert R.first_existing(spark, [str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path)


def test_cached_panel_builds_what_is_missing(spark, tmp_path):
    asked = []

    def build(seasons):
        asked.append(list(seasons))
        return spark.createDataFrame([(s, 1.0) for s in seasons], "season int, x double")

    path = str(tmp_path / "panel")
    R.cached_panel(spark, path, [1, 2], build)
    assert R.cached_panel(spark, path, [1, 2, 3], build).count() == 3
    assert asked == [[1, 2], [3]]


def test_refresh_loses_no_event_of_a_long_table(spark, tmp_path):
    from panelforge import queries as Q

    events = spark.range(4000).selectExpr("id AS event_id", "id % 97 AS user_id", "timestamp'2024-01-01' + make_dt_interval(id % 200) AS ts", "'click' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert Q.queries()["r1_refresh"](spark, str(tmp_path)).selectExpr("sum(n)").first()[0] == 4000


def test_bias_is_observed_less_predicted(spark):
    """By hand: 3 seen and 5 predicted is -2; 4 and 3 is 1; the cohort holds the first alone."""
    df = spark.createDataFrame([(3.0, 5.0, 0.6), (4.0, 3.0, 0.2)], "y double, p double, k double")
    r = df.agg(*L.metrics("y", "p", F.col("k") > 0.5)).first()
    assert (r["bias"], r["cohort_bias"], r["mae"]) == (-0.5, -2.0, 1.5)
    b = {x["bin"]: x["bias"] for x in K.bias_by_bin(df, "k", "y", ["p"], 2).collect()}
    assert b == {0: 1.0, 1: -2.0}


def test_predictors_rank_by_the_same_session(spark):
    rows = [(float(i), float(i), -float(i) + (i % 3), float((i * 7) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "same double, a double, later double, b double")
    got = {r["metric"]: r for r in K.predictor_table(df, ["a", "b"], "same", "later").collect()}
    assert got["a"]["position"] == 1 and got["b"]["position"] == 2 and got["a"]["r_later"] < 0


def test_nested_score_picks_the_penalty_without_the_fold(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i % 5, *map(float, rng.normal(size=4))) for i in range(60)]  # noise: nothing to find
    folds = L.moments(spark.createDataFrame(rows, "f int, a double, b double, c double, y double"), ["a", "b", "c"], "y", "f")
    nested = [L._r2(L.ridge_search({k: m for k, m in folds.items() if k != held}), folds[held]) for held in folds]
    assert np.mean(nested) <= L.fold_scores(folds).max() + 1e-12
    assert L.k_fold_score(folds) == np.sqrt(max(0.0, np.mean(nested)))


def test_moments_of_several_targets_and_far_from_zero(spark):
    import numpy as np

    x = np.arange(30) % 7 + 1e9
    df = spark.createDataFrame([(float(a), float(a * 2), float(-a)) for a in x], "x double, y double, z double")
    both = L.moments_of(df, ["x"], ["y", "z"])
    assert abs(L.solve(both["y"][0], 1e-9).coefficients[0] - 2) < 1e-6 and abs(L.solve(both["z"][0], 1e-9).coefficients[0] + 1) < 1e-6
    assert np.allclose(both["y"][0].centred[0, 0], ((x - x.mean()) ** 2).sum())


def test_names_and_movers(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, 2.0), (2, 4.0, 1.0, 1.2), (9, 1.0, 0.0, 3.0)], "e int, t double, o double, w double")
    names = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k int, n string")
    assert {r["e"]: r["name"] for r in P.named(df, names, "e", "k", "n").collect()} == {1: "a", 2: None, 9: None}
    assert [r["e"] for r in K.movers(df, "t", "e", "o", "w", 2, 0.5).collect()] == [1]


def test_fold_scores_for_all_penalties_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 4, *map(float, rng.normal(size=3)), 1.0) for i in range(50)]
    folds = L.moments(spark.createDataFrame([(f, a, b, c, a - b + c) for f, a, b, _, c in rows], "f int, a double, b double, flat double, y double"), ["a", "b", "flat"], "y", "f")
    scale = np.sqrt(np.diag(L.total(list(folds.values())).centred)[:3] / 50)
    for alpha, got in zip(L.ALPHAS[::13], L.fold_scores(folds)[::13]):
        each = [L._r2(L.solve(L.total([m for k, m in folds.items() if k != held]), alpha, scale), folds[held]) for held in folds]
        assert got == pytest.approx(np.mean(each), abs=1e-9)


@pytest.mark.parametrize("seed", [2, 7])
def test_penalties_equal_to_twelve_decimals(seed):
    """On rows that all stand there a hundred times, several penalties are as good as the best; the smallest is chosen."""
    rng, folds = np.random.default_rng(seed), {}
    for k in range(5):
        x = rng.normal(size=(400, 2))
        d = np.c_[x, x @ [1, 0.5] + rng.normal(0, 0.02, 400)]
        folds[k] = L.Moments(40_000.0, d.mean(axis=0), (d - d.mean(axis=0)).T @ (d - d.mean(axis=0)) * 100, ["a", "b"])
    scale = np.sqrt(np.diag(L.total(list(folds.values())).centred)[:2] / 200_000)
    scores = [np.mean([L._r2(L.solve(L.total([m for k, m in folds.items() if k != held]), a, scale), folds[held]) for held in folds]) for a in L.ALPHAS]
    equal = [a for a, s in zip(L.ALPHAS, scores) if round(s, 12) == round(max(scores), 12)]
    assert len(equal) > 1 and L.ridge_search(folds).alpha == equal[0] < L.ALPHAS[int(np.argmax(scores))]
