"""The season plan over the given tables: events, sessions, and the qualified season panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import family_of, flag, safe_ratio, weighted_score
from ..operators.panel import count_flags, qualified, season_thresholds, with_rates
from ..session import table

#: Seasons of the given tables, and what a row of a panel needs to count.
PRIOR, CURRENT = 2000, 2001
SEASONS = list(range(1995, 2002))
THRESHOLDS = {2001: (3, 20), 1997: (6, 40)}
DEFAULT_THRESHOLD = (10, 60)
WEIGHTS = {"k": 1.0, "ip": 3.3, "hit": -1.0, "swing": -0.5}
FAMILIES = {"FF": ["STANDARD", "ECONOMY"], "BR": ["LARGE", "MEDIUM"], "CH": ["SMALL", "PROMO"]}
FLAGS = ["swing", "hit", "contact", "in_zone", "z_swing", "o_swing", "k", "bip"]
RATES = {"swing_pct": ("swing", "n_events"), "contact_pct": ("contact", "swing"), "hit_pct": ("hit", "swing"), "zone_pct": ("in_zone", "n_events"), "k_pct": ("k", "n_events")}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: entity, season, session, measures and flags."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("session"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag",
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.nullif("l_discount", F.lit(0.0)).alias("disc"),
        F.col("l_tax").alias("tax"),
    )
    swing = F.col("l_returnflag").isin("A", "R")
    hit, k = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    zone = F.col("qty").between(1, 25)
    flags = {"swing": swing, "hit": hit, "contact": swing & ~hit, "in_zone": zone, "z_swing": swing & zone, "o_swing": swing & ~zone, "k": k, "bip": ~k & (F.col("l_returnflag") != "N")}
    outs = F.when(k & hit & (F.col("qty") > 45), 3).when(k & hit, 2).when(k, 1).otherwise(0)
    return line.withColumns({n: flag(c) for n, c in flags.items()}).withColumn("outs", outs)


def with_family(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    """Events with the family of their part's type."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", family_of("p_type", FAMILIES).alias("family"))
    return ev.join(part, "l_partkey")


def sessions(ev: DataFrame) -> DataFrame:
    """One row a session: counts, innings, score."""
    out = ev.groupBy("entity", "season", "session").agg(F.count("*").alias("n"), *count_flags(["swing", "hit", "k"]), F.sum("outs").alias("outs"))
    out = out.withColumn("ip", F.col("outs") / F.lit(3.0))
    return out.withColumn("score", weighted_score(WEIGHTS))


def season_panel(ev: DataFrame) -> DataFrame:
    """Season counts, means and rates by entity, and the means over its sessions, from one scan.

    Events are grouped by season and by session at once; a season's means are those of its events, in their order, and
    only what belongs to sessions is rolled up.
    """
    by_season, by_session = ["entity", "season"], ["entity", "season", "session"]
    means = [F.avg(c).alias(f"avg_{c}") for c in ("qty", "price", "disc")]
    value = safe_ratio(F.sum(F.col("price") * F.col("disc")), F.sum("qty")).alias("value_rate")
    both = ev.groupingSets([by_season, by_session], *by_session).agg(
        F.grouping("session").alias("of_season"), F.count("*").alias("n_events"), *count_flags(FLAGS), F.sum("outs").alias("outs"), *means, value
    )
    scored = both.withColumn("ip", F.col("outs") / F.lit(3.0)).withColumn("score", weighted_score(WEIGHTS))
    whole, part = F.col("of_season") == 1, F.col("of_season") == 0
    head = ["n_events", *FLAGS, "avg_qty", "avg_price", "avg_disc", "value_rate"]
    season = scored.groupBy(*by_season).agg(
        *(F.max(F.when(whole, F.col(c))).alias(c) for c in head),
        F.count_if(part).alias("n_sessions"),
        F.avg(F.when(part, F.col("ip"))).alias("ip_per_session"),
        F.avg(F.when(part, F.col("k"))).alias("k_per_session"),
        F.avg(F.when(part, F.col("score"))).alias("target"),
    )
    return with_rates(season, RATES).select(*by_season, *head, *RATES, "n_sessions", "ip_per_session", "k_per_session", "target")


def qualified_panel(panel: DataFrame) -> DataFrame:
    return qualified(panel, season_thresholds(THRESHOLDS, DEFAULT_THRESHOLD))


def derived(panel: DataFrame) -> DataFrame:
    """Interaction and polynomial features."""
    return panel.withColumns(
        {
            "swing_x_k": F.col("swing_pct") * F.col("k_pct"),
            "hit_sq": F.col("hit_pct") * F.col("hit_pct"),
            "log_price": F.ln("avg_price"),
            "qty_per_session": safe_ratio("avg_qty", "n_sessions"),
            "k_hit_gap": F.col("k_pct") - F.col("hit_pct"),
            "abs_gap": F.abs(F.col("k_pct") - F.col("hit_pct")),
            "root_events": F.sqrt("n_events"),
        }
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best qualified entity-seasons by their target."""
    panel = qualified_panel(season_panel(events(spark, sf_dir)))
    best = panel.select("entity", "season", "n_events", "n_sessions", F.round("swing_pct", 6).alias("swing_pct"), F.round("k_pct", 6).alias("k_pct"), F.round("target", 6).alias("target"))
    return best.orderBy(F.desc("target"), "entity", "season").limit(20)
