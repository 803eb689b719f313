"""Window features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranks as R
from ..operators import windows as W
from ..operators.comparing import bias_by_bin
from ..plans import season as S
from .base import ALL, panel, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""{ALL} SELECT entity, season, round(lag(target, 1) OVER w, 6) AS target_lag1, round(lag(target, 2) OVER w, 6) AS target_lag2, round(lag(k_pct, 1) OVER w, 6) AS k_pct_lag1, round(lag(k_pct, 2) OVER w, 6) AS k_pct_lag2,
round(avg(target) OVER (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS career, round(avg(target) OVER (PARTITION BY entity ORDER BY season ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) AS last2,
CAST(row_number() OVER w AS INT) AS ordinal, round(k_pct - lag(k_pct) OVER w, 6) AS k_delta FROM panel WINDOW w AS (PARTITION BY entity ORDER BY season)""")
def w1_w2_w3_w5_d7_lags(spark, sf_dir):
    p = W.lags(panel(spark, sf_dir), "entity", ["season"], ["target", "k_pct"])
    w = Window.partitionBy("entity").orderBy("season")
    out = p.withColumns({"career": W.expanding_mean("target", "entity", "season"), "last2": W.rolling_mean("target", "entity", ["season"], 2), "ordinal": F.row_number().over(w), "k_delta": F.col("k_pct") - F.col("k_pct_lag1")})
    return rounded(out.select("entity", "season", "target_lag1", "target_lag2", "k_pct_lag1", "k_pct_lag2", "career", "last2", "ordinal", "k_delta"))


@query(f"""{ALL} SELECT entity, season, session, {", ".join(f"round(CASE WHEN count({m}) OVER w >= 2 THEN avg({m}) OVER w END, 6) AS {m}_last5" for m in ("score", "ip", "k", "hit", "swing", "n"))} FROM se
WINDOW w AS (PARTITION BY entity ORDER BY season, session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def w4_rolling(spark, sf_dir):
    se = S.sessions(S.events(spark, sf_dir))
    out = se.withColumns({f"{m}_last5": W.rolling_mean(m, "entity", ["season", "session"], 5, 2) for m in ("score", "ip", "k", "hit", "swing", "n")})
    return rounded(out.select("entity", "season", "session", *[c for c in out.columns if c.endswith("_last5")]))


@query(f"""{ALL}, g AS (SELECT entity, season, round(target, 6) AS t, CASE WHEN k_pct > 0.45 THEN floor(k_pct * 40) END AS kk FROM panel)
SELECT entity, season, CAST(CASE WHEN kk IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY kk DESC NULLS LAST) END AS INT) AS place,
round(CASE WHEN kk IS NOT NULL THEN (rank() OVER (PARTITION BY season ORDER BY kk ASC NULLS LAST) + (count(kk) OVER (PARTITION BY season, kk) - 1) / 2) / count(kk) OVER (PARTITION BY season) END, 6) AS share,
CAST(row_number() OVER (PARTITION BY season ORDER BY t DESC, entity) AS INT) AS position FROM g""")
def w7_w8_w9_w10_ranks(spark, sf_dir):
    """Ranks within seasons by buckets of values, so that no task holds a season."""
    g = panel(spark, sf_dir).select("entity", "season", F.round("target", 6).alias("t"), F.when(F.col("k_pct") > 0.45, F.floor(F.col("k_pct") * 40)).alias("kk"))
    by_t = R.with_ranks(g, ["season"], "t", "entity", descending=True).select("entity", "season", "kk", F.col("_position").cast("int").alias("position"))
    ranked = R.with_ranks(by_t, ["season"], "kk", "entity")
    # From the largest: what is neither smaller nor equal stands before.
    place = F.col("_n") - F.col("_rank") - F.col("_ties") + 2
    return rounded(ranked.select("entity", "season", place.cast("int").alias("place"), ((F.col("_rank") + (F.col("_ties") - 1) / 2) / F.col("_n")).alias("share"), "position"))


@query(f"""{ALL} SELECT entity, season, session, round(score, 6) AS score FROM se QUALIFY row_number() OVER (PARTITION BY entity ORDER BY season DESC, session DESC) = 1""")
def w11_latest(spark, sf_dir):
    return rounded(W.latest(S.sessions(S.events(spark, sf_dir)), "entity", "season", "session").select("entity", "season", "session", "score"))


@query(f"""{ALL}, q AS (SELECT quantile_cont(k_pct, [0.2, 0.4, 0.6, 0.8]) AS e FROM panel), b AS (SELECT *, CAST((k_pct > e[1])::INT + (k_pct > e[2])::INT + (k_pct > e[3])::INT + (k_pct > e[4])::INT AS INT) AS bin FROM panel, q),
m AS (SELECT 'flat' AS model, bin, k_pct, 5.0 AS pred, target FROM b UNION ALL SELECT 'scaled', bin, k_pct, k_pct * 10, target FROM b)
SELECT model, bin, count(*) AS n, round(avg(k_pct), 6) AS mean_by, round(avg(target - pred), 6) AS bias FROM m GROUP BY ALL""")
def w12_a14_bias_by_bin(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", "k_pct", "target", F.lit(5.0).alias("flat"), (F.col("k_pct") * 10).alias("scaled"))
    return rounded(bias_by_bin(p, "k_pct", "target", ["flat", "scaled"]))


@query(f"""{ALL}, s AS (SELECT avg(k_pct) AS km, stddev_pop(k_pct) AS ks, avg(avg_qty) AS qm, stddev_pop(avg_qty) AS qs FROM panel), z AS (SELECT entity, season, (k_pct - km) / ks AS k_pct_z, -(avg_qty - qm) / qs AS avg_qty_z FROM panel, s),
y AS (SELECT *, (k_pct_z + avg_qty_z) / 2 AS z FROM z), l AS (SELECT avg(z) AS m, stddev_samp(z) AS d FROM y)
SELECT entity, season, round(k_pct_z, 6) AS k_pct_z, round(avg_qty_z, 6) AS avg_qty_z, round(z, 6) AS z, CASE WHEN z > m + 0.75 * d THEN 'HIGH' WHEN z < m - 0.75 * d THEN 'LOW' ELSE 'NORMAL' END AS label FROM y, l""")
def w13_c19_m21_trend(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", "k_pct", "avg_qty")
    out = W.trend_label(W.z_scores(p, {"k_pct": 1, "avg_qty": -1}), "z")
    return rounded(out.drop("k_pct", "avg_qty"))


@query(f"""{ALL}, c AS (SELECT entity, season, percent_rank() OVER (PARTITION BY season ORDER BY round(k_pct, 6), entity) AS share FROM panel) SELECT entity, round(avg(share), 6) AS mean_share FROM c GROUP BY ALL""")
def d6_percentile_profile(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", F.round("k_pct", 6).alias("k"))
    share = F.when(F.col("_n") > 1, (F.col("_position") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return rounded(R.with_ranks(p, ["season"], "k", "entity").withColumn("share", share).groupBy("entity").agg(F.avg("share").alias("mean_share")))
