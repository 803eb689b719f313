"""Sources, filters, scalars, joins, aggregates, sets and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import correlation
from ..functions import scalars as C
from ..operators import panel as P
from ..plans import season as S
from ..session import table
from .base import ALL, EVENTS, frames, panel, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""{ALL} SELECT entity, season, n_events, n_sessions, round(swing_pct, 6) AS swing_pct, round(k_pct, 6) AS k_pct, round(target, 6) AS target
FROM qp ORDER BY round(target, 6) DESC, entity, season LIMIT 20""")
def flagship_s1_p10_t2(spark, sf_dir):
    return S.flagship(spark, sf_dir)


@query(f"""{ALL} SELECT entity, season, n_events, swing, hit, contact, in_zone, z_swing, o_swing, k, bip, round(avg_qty, 6) AS avg_qty, round(avg_price, 6) AS avg_price, round(avg_disc, 6) AS avg_disc,
round(value_rate, 6) AS value_rate, round(swing_pct, 6) AS swing_pct, round(contact_pct, 6) AS contact_pct, round(hit_pct, 6) AS hit_pct, round(zone_pct, 6) AS zone_pct, round(k_pct, 6) AS k_pct,
n_sessions, round(ip_per_session, 6) AS ip_per_session, round(k_per_session, 6) AS k_per_session, round(target, 6) AS target FROM panel""")
def a1_a3_a5_j1_season_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query(f"""{ALL} SELECT entity, season, session, n, CAST(swing AS BIGINT) AS swing, CAST(hit AS BIGINT) AS hit, CAST(k AS BIGINT) AS k, outs, round(ip, 6) AS ip, round(score, 6) AS score FROM se""")
def a2_c5_c6_p6_sessions(spark, sf_dir):
    return rounded(S.sessions(S.events(spark, sf_dir)))


@query(f"""{ALL} SELECT entity, season, round(swing_pct * k_pct, 6) AS swing_x_k, round(hit_pct * hit_pct, 6) AS hit_sq, round(ln(avg_price), 6) AS log_price, round(avg_qty / nullif(n_sessions, 0), 6) AS qty_per_session,
round(k_pct - hit_pct, 6) AS k_hit_gap, round(abs(k_pct - hit_pct), 6) AS abs_gap, round(sqrt(n_events), 6) AS root_events, round(CASE WHEN k_pct < 0.5 THEN 0.5 ELSE k_pct END, 6) AS clipped,
CAST(sign(k_pct - hit_pct) AS DOUBLE) AS side, round(degrees(atan(k_pct)), 6) AS angle FROM panel""")
def c2_c3_c4_derived(spark, sf_dir):
    out = S.derived(panel(spark, sf_dir))
    out = out.withColumns({"clipped": C.clip_lower("k_pct", 0.5), "side": F.signum(F.col("k_pct") - F.col("hit_pct")), "angle": F.degrees(F.atan("k_pct"))})
    return rounded(out.select("entity", "season", "swing_x_k", "hit_sq", "log_price", "qty_per_session", "k_hit_gap", "abs_gap", "root_events", "clipped", "side", "angle"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price, round(degrees(atan((vz + az * t) / abs(vy + ay * t))), 6) AS angle FROM (
SELECT *, (-vy - CASE WHEN vy * vy - 2 * ay * d >= 0 THEN sqrt(CASE WHEN vy * vy - 2 * ay * d >= 0 THEN vy * vy - 2 * ay * d ELSE 0 END) END) / ay AS t FROM (
SELECT *, -100 - l_quantity AS vy, -l_tax * 50 AS vz, 20 + l_discount * 1000 + l_quantity * 2 AS ay, -32.0 + l_tax * 10 AS az, 60.5 - (6 + l_discount) - 1.417 AS d FROM lineitem))""")
def c16_approach_angle(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    angle = C.approach_angle(-100 - q, -t * 50, 20 + d * 1000 + q * 2, F.lit(-32.0) + t * 10, 6 + d)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"), F.round(angle, 6).alias("angle"))


@query("""SELECT page_id, trim(regexp_replace(substr(url, 1, 40), '<[^>]+>', '', 'g')) AS url, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) AS n_text FROM pages""")
def c12_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.strip_tags(F.substring("url", 1, 40)).alias("url"), F.length(C.strip_tags("html")).cast("long").alias("n_text"))


@query("""SELECT page_id, trim(regexp_replace(url, '<[^>]+>', '', 'g')) AS url FROM pages""")
def c12_strip_tags_whole(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.strip_tags("url").alias("url"))


@query(f"""{ALL}, t AS (SELECT bool_and(swing_pct BETWEEN 0 AND 1) AS a, bool_and(big_pct BETWEEN 0 AND 1) AS b FROM (SELECT *, k_pct * 3 AS big_pct FROM panel))
SELECT entity, season, CASE WHEN t.a THEN round(swing_pct * 100, 2) ELSE round(swing_pct, 6) END AS swing_pct, CASE WHEN t.b THEN round(k_pct * 300, 2) ELSE round(k_pct * 3, 6) END AS big_pct FROM panel, t""")
def c17_a17_rescale(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", "swing_pct", (F.col("k_pct") * 3).alias("big_pct"))
    return rounded(C.rescale_percents(p))


@query(f"""{ALL}, g AS (SELECT entity, season, CASE WHEN k_pct > 0.5 THEN NULL ELSE avg_qty END AS q FROM panel), m AS (SELECT median(q) AS m FROM g)
SELECT entity, season, round(coalesce(q, m), 6) AS q FROM g, m""")
def c18_impute_median(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", F.when(~(F.col("k_pct") > 0.5), F.col("avg_qty")).alias("q"))
    return rounded(C.impute_median(p, ["q"]))


@query(f"""{ALL} SELECT entity, season, round((n_events * k_pct + 40 * 0.3117) / (n_events + 40), 6) AS shrunken, coalesce(avg_disc, 0) AS filled FROM (SELECT * REPLACE (round(avg_disc, 6) AS avg_disc) FROM panel)""")
def c7_c14_shrink(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("entity", "season", F.round(C.shrink("k_pct", "n_events", 0.3117, 40), 6).alias("shrunken"), F.coalesce(F.round("avg_disc", 6), F.lit(0.0)).alias("filled"))


@query("""SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'engaged' WHEN 'purchase' THEN 'converted' END AS meaning, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
try_cast(event_type AS DOUBLE) AS bad, coalesce(contains(event_type, 'ic'), false) AS has_ic FROM events""")
def c15_p12_p15_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = C.lenient_double(F.get_json_object("props", "$.k"))
    return ev.select(
        "event_id", "event_type", C.by_key("event_type", {"click": "engaged", "purchase": "converted"}).alias("meaning"), k.alias("k"),
        C.lenient_double("event_type").alias("bad"), C.flag(F.col("event_type").contains("ic")).alias("has_ic"),
    )


@query(f"""{ALL} SELECT a.entity, a.season AS from_season, a.season + 1 AS to_season, round(a.k_pct, 6) AS k_pct, round(a.avg_qty, 6) AS avg_qty, round(b.target, 6) AS next_target
FROM panel a JOIN panel b ON a.entity = b.entity AND b.season = a.season + 1""")
def j4_j8_lag_join(spark, sf_dir):
    return rounded(P.lag_join(panel(spark, sf_dir), "entity", "season", ["k_pct", "avg_qty"], "target"))


@query(f"""WITH {EVENTS}, f AS (SELECT l_orderkey, l_linestatus, arg_min(entity, (ts, l_linenumber, l_partkey, price, entity)) AS first FROM ev GROUP BY ALL)
SELECT entity, season, count(*) AS n_starts, round(sum(price), 2) AS price FROM ev JOIN f USING (l_orderkey, l_linestatus) WHERE entity = first GROUP BY ALL""")
def j5_a4_starters(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    own = P.starters(ev, ["l_orderkey", "l_linestatus"], "entity", ["ts", "l_linenumber", "l_partkey", "price"])
    return own.groupBy("entity", "season").agg(F.count("*").alias("n_starts"), F.round(F.sum("price"), 2).alias("price"))


@query(f"""{ALL}, a AS (SELECT * FROM qp WHERE season = 2000), b AS (SELECT * FROM qp WHERE season = 2001)
SELECT coalesce(a.entity, b.entity) AS entity, round(a.k_pct, 6) AS prior_k_pct, a.n_events AS prior_n_events, round(b.k_pct, 6) AS current_k_pct, b.n_events AS current_n_events FROM a FULL JOIN b ON a.entity = b.entity""")
def j6_j7_x2_paired(spark, sf_dir):
    return rounded(P.paired_seasons(S.qualified_panel(panel(spark, sf_dir)), "entity", "season", S.PRIOR, S.CURRENT, ["k_pct", "n_events"]))


@query(f"""{ALL}, n AS (SELECT entity, round(target, 6) AS target FROM qp WHERE season = 2001 AND k_pct > 0.5), o AS (SELECT entity, round(target, 6) AS target FROM qp WHERE season = 2000)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE entity NOT IN (SELECT entity FROM n)""")
def j9_x1_fallback(spark, sf_dir):
    q = S.qualified_panel(panel(spark, sf_dir))
    new = q.where((F.col("season") == 2001) & (F.col("k_pct") > 0.5)).select("entity", F.round("target", 6).alias("target"))
    old = q.where("season = 2000").select("entity", F.round("target", 6).alias("target"))
    return P.with_fallback(new, old, ["entity"])


@query(f"""{ALL}, a AS (SELECT session, round(avg(score), 6) AS m FROM se WHERE season = 2000 AND session <= 9 GROUP BY 1), b AS (SELECT session, round(avg(score), 6) AS m FROM se WHERE season = 2001 AND session >= 3 GROUP BY 1)
SELECT coalesce(a.session, b.session) AS session, a.m AS prior_mean, b.m AS current_mean FROM a FULL JOIN b ON a.session = b.session""")
def j11_j12_a13_season_means(spark, sf_dir):
    se = S.sessions(S.events(spark, sf_dir))
    a = se.where("season = 2000 AND session <= 9").groupBy("session").agg(F.round(F.avg("score"), 6).alias("prior_mean"))
    b = se.where("season = 2001 AND session >= 3").groupBy("session").agg(F.round(F.avg("score"), 6).alias("current_mean"))
    return a.join(b, "session", "full_outer")


@query(f"""WITH {EVENTS}, fa AS (SELECT ev.*, CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'FF' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'BR' ELSE 'CH' END AS family FROM ev JOIN part ON l_partkey = p_partkey)
SELECT entity, season, {", ".join(f"round(CASE WHEN count(CASE WHEN family = '{f}' THEN {m} END) >= 20 THEN avg(CASE WHEN family = '{f}' THEN {m} END) END, 6) AS {f.lower()}_{m}" for f in ("FF", "BR", "CH") for m in ("qty", "disc"))} FROM fa GROUP BY ALL""")
def a6_a7_p17_category_panel(spark, sf_dir):
    ev = S.with_family(spark, sf_dir, S.events(spark, sf_dir))
    return rounded(P.category_panel(ev, ["entity", "season"], "family", list(S.FAMILIES), ["qty", "disc"], 20))


@query(f"""WITH {EVENTS}, c AS (SELECT entity, season, p_type, count(*) AS n FROM ev JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY entity, season) AS p FROM c)
SELECT entity, season, round(-sum(p * ln(p)), 6) AS mix_entropy FROM s WHERE p >= 0.12 GROUP BY ALL""")
def a8_w6_mix_entropy(spark, sf_dir):
    return rounded(P.mix_entropy(S.with_family(spark, sf_dir, S.events(spark, sf_dir)), ["entity", "season"], "p_type", 0.12))


@query(f"""{ALL} SELECT season, count(*) AS n, round(corr(k_pct, target), 4) AS r, round(sqrt(avg((k_pct * 10 - target) * (k_pct * 10 - target))), 6) AS rmse, round(avg(abs(k_pct * 10 - target)), 6) AS mae,
round(avg(target - k_pct * 10), 6) AS bias, round(avg(CASE WHEN k_pct > 0.5 THEN target - k_pct * 10 END), 6) AS cohort_bias, CAST(count_if(k_pct > 0.5) AS BIGINT) AS n_cohort FROM panel GROUP BY ALL""")
def a9_a10_a16_p16_metrics(spark, sf_dir):
    from ..operators.linear import metrics

    p = panel(spark, sf_dir).withColumn("pred", F.col("k_pct") * 10)
    out = p.groupBy("season").agg(*metrics("target", "pred", F.col("k_pct") > 0.5), F.count_if(F.col("k_pct") > 0.5).alias("n_cohort"))
    return rounded(out.withColumn("r", F.round("r", 4)))


@query(f"""{ALL} SELECT season, count(DISTINCT entity) AS n_entities, count(avg_disc) AS n_disc, round(avg(target), 6) AS mean, round(median(target), 6) AS median, round(min(target), 6) AS least, round(max(target), 6) AS most, round(stddev_samp(target), 6) AS std FROM panel GROUP BY ALL""")
def a11_a12_describe(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "season", "avg_disc", "target")
    return rounded(P.describe(p, "target", ["season"], [F.count_distinct("entity").alias("n_entities"), F.count("avg_disc").alias("n_disc")]))


@query(f"""{ALL} SELECT 'avg_disc' AS feature, count(avg_disc) AS n_present FROM panel UNION ALL SELECT 'k_pct', count(k_pct) FROM panel UNION ALL SELECT 'big', count(CASE WHEN k_pct > 0.5 THEN 1 END) FROM panel""")
def p18_coverage(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("big", F.when(F.col("k_pct") > 0.5, 1))
    return P.coverage(p, ["avg_disc", "k_pct", "big"])


@query(f"""{ALL} SELECT entity, season, round(k_pct, 6) AS k_pct FROM panel WHERE season BETWEEN 1996 AND 1999 AND k_pct IS NOT NULL AND avg_disc IS NOT NULL ORDER BY abs(round(k_pct, 6) - 0.5) DESC, entity, season LIMIT 25""")
def p3_p9_t3_t4_extremes(spark, sf_dir):
    p = panel(spark, sf_dir).where(F.col("season").between(1996, 1999)).na.drop(subset=["k_pct", "avg_disc"])
    return p.select("entity", "season", F.round("k_pct", 6).alias("k_pct")).orderBy(F.desc(F.abs(F.col("k_pct") - 0.5)), "entity", "season").limit(25)


@query(f"""{ALL}, a AS (SELECT DISTINCT entity FROM qp WHERE season = 2000), b AS (SELECT DISTINCT entity FROM qp WHERE season = 1999)
SELECT 'both' AS kind, entity FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'gone', entity FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def x3_x4_x5_sets(spark, sf_dir):
    """Keys of two seasons, both or the earlier one alone, from one grouping."""
    q = S.qualified_panel(panel(spark, sf_dir)).where("season in (1999, 2000)")
    seen = q.groupBy("entity").agg(F.max(F.col("season") == 2000).alias("now"), F.max(F.col("season") == 1999).alias("before"))
    return seen.where("before").select(F.when(F.col("now"), "both").otherwise("gone").alias("kind"), "entity")


@query(f"""{ALL}, w AS (SELECT season, session, round(avg(score), 6) AS m FROM se GROUP BY ALL) SELECT * FROM w WHERE m > (SELECT avg(score) FROM se) ORDER BY m DESC, season, session LIMIT 12""")
def t1_t5_winners(spark, sf_dir):
    se = S.sessions(S.events(spark, sf_dir))
    w = se.groupBy("season", "session").agg(F.round(F.avg("score"), 6).alias("m"))
    base = se.agg(F.avg("score").alias("base"))
    return w.crossJoin(F.broadcast(base)).where("m > base").drop("base").orderBy(F.desc("m"), "season", "session").limit(12)


@query(f"""{ALL} SELECT entity, season, session, CAST(k AS BIGINT) AS k, round(greatest(score - 2, 0), 6) AS over FROM se WHERE season IN (1999, 2000)""")
def s14_c21_p1_season_list(spark, sf_dir):
    se = S.sessions(S.events(spark, sf_dir)).where(F.col("season").isin(1999, 2000))
    return se.select("entity", "season", "session", "k", F.round(C.clip_lower(F.col("score") - 2, 0.0), 6).alias("over"))


@query(f"""WITH {EVENTS} SELECT entity, season, round(avg(CASE WHEN bip AND disc IS NOT NULL THEN disc ELSE tax END), 6) AS mixed, round(avg(CASE WHEN bip THEN price END), 6) AS bip_price FROM ev GROUP BY ALL""")
def p7_p8_override(spark, sf_dir):
    ev = S.events(spark, sf_dir)
    mixed = F.when(F.col("bip") & F.col("disc").isNotNull(), F.col("disc")).otherwise(F.col("tax"))
    return rounded(ev.groupBy("entity", "season").agg(F.avg(mixed).alias("mixed"), F.avg(F.when(F.col("bip"), F.col("price"))).alias("bip_price")))


@query(f"""{ALL} SELECT entity, count(*) AS n_seasons, min(season) AS first_season, round(avg(target), 6) AS mean_target, round(stddev_samp(target), 6) AS std_target FROM panel GROUP BY ALL""")
def d11_career(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(p.groupBy("entity").agg(F.count("*").alias("n_seasons"), F.min("season").alias("first_season"), F.avg("target").alias("mean_target"), F.stddev_samp("target").alias("std_target")))


@query(f"""{ALL}, f AS (SELECT entity, season, session, arg_min(swing, (ts, l_orderkey, l_linenumber, l_partkey, price)) AS first_swing FROM ev GROUP BY ALL)
SELECT f.entity, f.season, round(count_if(first_swing) / count(*), 6) AS first_rate, round(any_value(c.std), 6) AS qty_std FROM f JOIN (SELECT entity, season, stddev_samp(qty) AS std FROM ev GROUP BY ALL) c USING (entity, season) GROUP BY ALL""")
def d8_d9_first_rate(spark, sf_dir):
    ev, _ = frames(spark, sf_dir)
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "price"]
    f = ev.groupBy("entity", "season", "session").agg(P.first_by("swing", *order).alias("first_swing"))
    f = f.groupBy("entity", "season").agg((F.count_if(F.col("first_swing")) / F.count("*")).alias("first_rate"))
    return rounded(f.join(ev.groupBy("entity", "season").agg(F.stddev_samp("qty").alias("qty_std")), ["entity", "season"]))


@query(f"""{ALL} SELECT entity, season, s_name AS name, n_events, round(target, 6) AS target FROM panel LEFT JOIN supplier ON s_suppkey = entity""")
def j10_names(spark, sf_dir):
    """The panel with its entities' names."""
    return rounded(P.named(panel(spark, sf_dir).select("entity", "season", "n_events", "target"), table(spark, sf_dir, "supplier"), "entity", "s_suppkey", "s_name"))


#: Features with the tag that says what they know of the target: nothing of it, its own season, or the target itself.
TAGS = {"k_pct": "clean", "swing_pct": "clean", "hit_pct": "clean", "avg_qty": "clean", "ip_per_session": "semi_circular", "k_per_session": "semi_circular", "target": "circular"}


@query(f"""{ALL} """ + " UNION ALL ".join(f"""SELECT '{f}' AS feature, '{t}' AS tag, count({f}) AS n, round(corr({f}, target), 4) AS r FROM panel""" for f, t in TAGS.items()))
def d12_feature_registry(spark, sf_dir):
    """Every feature with its provenance tag, how many rows have it, and its correlation with the target."""
    p = panel(spark, sf_dir)
    seen = p.agg(*[F.count(f).alias(f"n_{f}") for f in TAGS], *[correlation(f, "target").alias(f"r_{f}") for f in TAGS])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("tag"), F.col(f"n_{f}").alias("n"), F.col(f"r_{f}").alias("r")) for f, t in TAGS.items()])
    return rounded(seen.select(F.inline(rows)), 4)
