"""Bucketed upserts, pruned scans, and the rules that decide between models."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import comparing as K
from panelforge.sources import tables as R
from panelforge.streaming import refresh as X

ROWS = "user long, day int, n long"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "table")


def read(spark, folder):
    return sorted(tuple(r) for r in X.current(spark, folder).select("user", "day", "n").collect())


def test_upsert_touches_its_buckets_alone(spark, folder):
    first = [(u, d, 1) for u in range(40) for d in range(3)]
    X.upsert(spark.createDataFrame(first, ROWS), folder, ["user", "day"], "user", 0)
    before = X.versions(spark, folder)
    touched = X.upsert(spark.createDataFrame([(7, 1, 9), (7, 5, 4)], ROWS), folder, ["user", "day"], "user", 1)
    after = X.versions(spark, folder)
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    assert read(spark, folder) == sorted([r for r in first if r[:2] != (7, 1)] + [(7, 1, 9), (7, 5, 4)])


def test_folder_stops_growing(spark, folder):
    for number in range(5):
        X.upsert(spark.createDataFrame([(u, 0, number) for u in range(30)], ROWS), folder, ["user", "day"], "user", number)
    assert all(len(v) <= 2 for v in X.versions(spark, folder).values())
    assert read(spark, folder) == [(u, 0, 4) for u in range(30)]


def test_batch_that_runs_again_replaces_itself(spark, folder):
    X.upsert(spark.createDataFrame([(1, 0, 5), (2, 0, 5)], ROWS), folder, ["user", "day"], "user", 0)
    for n in (6, 7):  # the first try of batch 1 failed after it had written
        X.upsert(spark.createDataFrame([(1, 0, n), (1, 1, n)], ROWS), folder, ["user", "day"], "user", 1)
    assert read(spark, folder) == [(1, 0, 7), (1, 1, 7), (2, 0, 5)]


def test_table_that_is_not_there(spark, folder):
    assert X.versions(spark, folder) == {}
    with pytest.raises(FileNotFoundError):
        X.current(spark, folder)


def test_derived_rows_of_touched_entities_alone(spark, tmp_path):
    """Two batches; only the users of a batch are derived in it."""
    t0, seen = datetime(2024, 1, 1), []
    schema = "user long, ts timestamp, n long"
    for i, users in enumerate(([1, 2, 3], [3, 4])):
        rows = [(u, t0 + timedelta(days=i, hours=u), 1) for u in users]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        # Files are taken in the order of their times.
        newest = max((tmp_path / "landed").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + 100 * i,) * 2)
    stream = X.landed(spark, str(tmp_path / "landed"), spark.createDataFrame([], schema).schema, 1)

    def derive(days):
        out = days.groupBy("user").agg(F.sum("n").alias("total"))
        seen.append(sorted(r["user"] for r in out.select("user").collect()))
        return out

    X.refresh(X.session_totals(stream, "user", "ts", "1 day", {"n": F.sum("n")}, late="9 days"), str(tmp_path / "table"), ["window", "user"], str(tmp_path / "log"), "user", derive, str(tmp_path / "derived"))
    assert [s for s in seen if s] == [[1, 2, 3], [3, 4]]
    assert sorted(tuple(r) for r in X.current(spark, str(tmp_path / "derived")).select("user", "total").collect()) == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_scan_prunes_at_run_time(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.range(60).select(F.col("id").alias("x"), (F.col("id") % 6).cast("int").alias("season")).write.partitionBy("season").parquet(path)
    spark.createDataFrame([(s, s > 3) for s in range(6)], "season int, good boolean").write.parquet(str(tmp_path / "seasons"))
    df = R.scan_seasons(spark, path, spark.read.parquet(str(tmp_path / "seasons")).where("good"), ["season", "x"])
    assert sorted({r.season for r in df.collect()}) == [4, 5]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()


def scored(spark, rows):
    return spark.createDataFrame(rows, "name string, target double, old double, new double")


UP, DOWN, FLAT = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], [1.0, 1.0, 1.0]


@pytest.mark.parametrize("new, wanted, decision", [(UP, {"nn": 0.5}, "PASS"), (UP, {"nna": 1.5}, "PASS"), (UP, {"nn": 1.5}, "PARTIAL"), (UP, {"nna": 2.0}, "PARTIAL"), (DOWN, {}, "PARTIAL"), (UP, {"nobody": 0.0}, "PARTIAL"), (FLAT, {}, "PARTIAL")])
def test_ship_decision(spark, new, wanted, decision):
    """Of several names with a part the first counts; no correlation, an absent name and a mark that is only reached don't pass."""
    rows = [(n, float(t), float(t), x) for n, t, x in zip(["Ann", "Anna", None], [1, 2, 3], new)]
    assert K.ship_decision(scored(spark, rows), "target", "old", "new", F.col("name"), wanted).first().decision == decision


def test_merge_guards(spark):
    before = spark.range(100)
    after = spark.range(86).select(F.when(F.col("id") == 3, F.lit(float("nan"))).when(F.col("id") == 4, F.lit(float("inf"))).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["check"]: (r.observed, r.passed) for r in K.merge_guards(before, after).collect()}
    assert got["odd"] == (2.0, False) and got["lost"][1] and np.isclose(got["lost"][0], 0.14)
    assert {r["check"]: r.passed for r in K.merge_guards(before, spark.range(84)).collect()} == {"lost": False, "odd": True}
    assert {r["check"]: r.passed for r in K.merge_guards(before.limit(0), before.limit(0)).collect()} == {"lost": True, "odd": True}


def test_composite_trend(spark):
    """Rows that lack a chosen metric are out; a metric of one value has no z-score."""
    rows = spark.createDataFrame([(i, float(i), float(-i), 5.0, None if i == 9 else 1.0 * i) for i in range(10)], "id long, a double, b double, c double, d double")
    best = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("d", 1.0)], "metric string, sign double")
    got = {r.id: (r.score, r.trend) for r in K.composite_trend(rows, ["id"], ["a", "b", "c", "d"], best).collect()}
    z = (np.arange(9) - 4) / np.arange(9).std()
    assert sorted(got) == list(range(9)) and np.allclose([got[i][0] for i in range(9)], z)
    assert [got[i][1] for i in (0, 4, 8)] == ["LOW", "NORMAL", "HIGH"]
    assert K.composite_trend(rows, ["id"], ["a"], best.limit(0)).collect() == []
