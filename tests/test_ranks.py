"""Distributed ranks and exact quantiles against pandas, with ties that hold a third of all rows, missing values and small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import panel as P
from panelforge.operators import ranks as R
from panelforge.operators import windows as W


def rows(seed, n=3000):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(5, 3, n), 1))
    x = np.where(rng.random(n) < 0.1, np.nan, x)
    out = pd.DataFrame({"g": rng.choice(["a", "a", "a", "b"], n), "x": x, "id": rng.permutation(n), "_note": "kept"})
    tail = pd.DataFrame({"g": ["one", "none", "none"], "x": [1.5, np.nan, np.nan], "id": [n, n + 1, n + 2], "_note": "kept"})
    return pd.concat([out, tail], ignore_index=True)


def frame(spark, data):
    plain = [(g, None if np.isnan(x) else float(x), int(i), note) for g, x, i, note in data.itertuples(index=False, name=None)]
    return spark.createDataFrame(plain, "g string, x double, id long, note string").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(spark, descending):
    data = rows(1)
    got = R.with_ranks(frame(spark, data), ["g"], "x", "id", descending, buckets=8).toPandas().set_index("id").sort_index()
    want = data.set_index("id").sort_index()
    by = want.groupby("g").x
    sign = -1 if descending else 1
    position = (want.assign(v=sign * want.x).dropna(subset=["x"]).sort_values(["v", "id"], kind="stable").groupby("g").cumcount() + 1).reindex(want.index)
    for name, values in {"_rank": by.rank("min", ascending=not descending), "_n": by.transform("count").where(want.x.notna()), "_ties": want.groupby(["g", "x"]).x.transform("count"), "_position": position}.items():
        assert np.array_equal(got[name].astype(float), values.astype(float), equal_nan=True), name
    assert list(got.columns) == ["g", "x", "note", "_n", "_rank", "_ties", "_position"]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles(spark, by):
    data, shares = rows(2), [0.0, 0.2, 0.5, 0.61, 1.0]
    got = R.exact_quantiles(frame(spark, data), "x", shares, by, buckets=16).collect()
    if not by:
        assert np.allclose(got[0].quantiles, data.x.quantile(shares))
        return
    assert {r.g for r in got} == {"a", "b", "one", "none"}
    for r in got:
        own = data[data.g == r.g].x
        assert (r.quantiles is None) if r.g == "none" else np.allclose(r.quantiles, own.quantile(shares))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double, id long")
    assert R.exact_quantiles(empty, "x", [0.5]).collect()[0].quantiles is None
    assert R.exact_quantiles(empty, "x", [0.5], ["g"]).collect() == []
    assert R.with_ranks(empty, ["g"], "x", "id").collect() == []
    assert W.quantile_bins(empty, "x", 5).collect() == []


def test_describe(spark):
    got = {r.g: r for r in P.describe(frame(spark, rows(3)), "x", ["g"]).collect()}
    own = rows(3)[rows(3).g == "a"].x
    assert np.allclose([got["a"].median, got["a"]["std"], got["a"].least], [own.median(), own.std(), own.min()])


def test_no_task_holds_a_season(spark, small):
    """Rows are dealt by season and bucket, never by season alone."""
    from panelforge.queries import queries

    plan = queries()["w7_w8_w9_w10_ranks"](spark, small)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(season" in line]
    assert dealt and all("_b#" in line.split("hashpartitioning(")[1] for line in dealt)
