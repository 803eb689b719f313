"""Sinks, caches, logs, exported records and the streaming refresh; each writes to a folder of its own and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.scalars import correlation
from ..operators import comparing as K
from ..operators import linear as L
from ..plans import season as S
from ..session import table
from ..sources import tables as R
from ..sources.tables import own_folder
from ..streaming import refresh as X
from .base import ALL, panel, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""{ALL} SELECT entity, season, n_events, round(k_pct, 6) AS k_pct FROM panel WHERE season IN (1999, 2000, 2001)""")
def s1_s7_s9_cached_panel(spark, sf_dir):
    """The panel of two seasons is cached, then three are asked for, and only the third is built."""
    path = own_folder(spark)
    build = lambda seasons: rounded(panel(spark, sf_dir).where(F.col("season").isin(*seasons)).select("entity", "season", "n_events", "k_pct"))
    R.cached_panel(spark, path, [1999, 2000], build)
    return R.cached_panel(spark, path, [1999, 2000, 2001], build)


@query(f"""{ALL} SELECT entity, season, round(k_pct, 6) AS k_pct FROM panel WHERE season < 2000 UNION ALL SELECT entity, season, 0.5 FROM panel WHERE season >= 2000""")
def s9_overwritten_seasons(spark, sf_dir):
    path = own_folder(spark)
    p = rounded(panel(spark, sf_dir).select("entity", "season", "k_pct"))
    p.write.partitionBy("season").parquet(path)
    R.write_seasons(p.where("season >= 2000").withColumn("k_pct", F.lit(0.5)), path)
    return spark.read.parquet(path)


@query(f"""{ALL} SELECT entity, season, round(target, 6) AS target, CAST(NULL AS DOUBLE) AS absent FROM panel""")
def s3_s4_s8_p13_p14_csv(spark, sf_dir):
    path = own_folder(spark)
    rounded(panel(spark, sf_dir).select("entity", "season", "target")).write.csv(path, header=True)
    df = R.read_csv(spark, [f"{path}-none", path], "entity long, season int, target double")
    return R.with_schema(df, R.T.StructType.fromDDL("entity long, season int, target double, absent double"))


@query(f"""{ALL} SELECT entity, season, n_events, CAST(NULL AS DOUBLE) AS extra FROM panel WHERE season IN (1999, 2000)""")
def s2_s5_s6_union_seasons(spark, sf_dir):
    path = own_folder(spark)
    p = panel(spark, sf_dir).select("entity", "season", "n_events")
    for s in (1999, 2000):
        p.where(F.col("season") == s).drop("season").write.parquet(f"{path}/{s}")
    df = R.union_seasons(spark, {s: f"{path}/{s}" for s in (1998, 1999, 2000)})
    return R.join_optional(df, f"{path}/none", ["entity"], R.T.StructType.fromDDL("entity long, extra double"))


@query(f"""{ALL} SELECT 'm' || season AS label, count(*) AS n, round(corr(k_pct, target), 4) AS r FROM panel GROUP BY season""")
def s10_c20_log(spark, sf_dir):
    path = own_folder(spark)
    p = panel(spark, sf_dir)
    for some in (p.where("season < 1999"), p.where("season >= 1999")):
        rows = some.groupBy("season").agg(F.count("*").alias("n"), correlation("k_pct", "target").alias("r"))
        R.append_log(rows.select(F.concat(F.lit("m"), F.col("season").cast("string")).alias("label"), "n", "r", F.current_timestamp().alias("run_ts")), path)
    return spark.read.parquet(path).select("label", "n", F.round("r", 4).alias("r"))


@query(f"""{ALL} SELECT 'm' || season AS label, count(*) AS n, true AS stamped FROM panel GROUP BY season""")
def c20_stamped_log(spark, sf_dir):
    """Records carry the time of their run: between the run's begin and its end, the same for all records of one append."""
    path = own_folder(spark)
    began = spark.sql("SELECT now() AS t").first()["t"]
    rows = panel(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"))
    R.append_log(rows.select(F.concat(F.lit("m"), F.col("season").cast("string")).alias("label"), "n", F.current_timestamp().alias("run_ts")), path)
    log = spark.read.parquet(path)
    times = log.agg(F.count_distinct("run_ts").alias("_times"))
    within = F.col("run_ts").between(F.lit(began), F.current_timestamp()) & (F.col("_times") == 1)
    return log.crossJoin(F.broadcast(times)).select("label", "n", F.coalesce(within, F.lit(False)).alias("stamped"))


@query("""SELECT event_id AS id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS missing FROM events""")
def s11_json_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    payload = ev.select(F.to_json(F.struct(F.array(F.struct("event_id", F.get_json_object("props", "$.k").alias("k"))).alias("data"))).alias("payload"))
    rows = R.stats_from_json(payload, "payload", {"event_id": "id", "k": "value", "z": "missing"})
    return rows.select(F.col("id").cast("long"), F.col("value").try_cast("double").alias("value"), F.col("missing").try_cast("double").alias("missing"))


@query(f"""{ALL} SELECT '{{"entity":' || entity || ',"season":' || season || ',"n_events":' || n_events || '}}' AS record FROM panel""")
def s12_json_records(spark, sf_dir):
    return R.as_json_records(panel(spark, sf_dir).select("entity", "season", "n_events"))


@query()
def s13_model_tables(spark, sf_dir):
    path = own_folder(spark)
    p = panel(spark, sf_dir)
    fit = L.ridge_search(L.moments(p, ["k_pct", "swing_pct"], "target", "season"))
    R.save_model(spark, path, fit, {"n": 1.0})
    again = R.load_model(spark, path)
    return p.select("entity", "season", fit.predict().alias("saved"), again.predict().alias("loaded"))


@query(f"""{ALL}, s AS (SELECT avg(k_pct) AS xa, avg(target) AS ya, covar_pop(k_pct, target) / (var_pop(k_pct) * (1 + 10.0 / count(*))) AS c FROM panel)
SELECT entity, season, round(ya + c * (k_pct - xa), 4) AS saved, round(ya + c * (k_pct - xa), 4) AS loaded FROM panel, s""")
def s13_model_reload(spark, sf_dir):
    """Predictions of a fit and of the same fit written and read again."""
    path = own_folder(spark)
    p = panel(spark, sf_dir)
    fit = L.solve(L.moments(p, ["k_pct"], "target")[0], 10.0)
    R.save_model(spark, path, fit, {"n": 1.0})
    return rounded(p.select("entity", "season", fit.predict().alias("saved"), R.load_model(spark, path).predict().alias("loaded")), 4)


def _user_days(spark, sf_dir, path, files, derive=None):
    """User-days of the landed events, merged batch by batch, and what ``derive`` makes of the users of each batch."""
    events = table(spark, sf_dir, "events")
    events.repartition(16, "user_id").write.parquet(f"{path}/landed")
    stream = X.landed(spark, f"{path}/landed", events.schema, files).withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = {k: F.count_if(F.col("event_type") == k) for k in ("purchase", "click", "error")}
    sums = {"n": F.count("*"), "total": F.sum("value"), **kinds}
    # Files are split by user, so each may hold events as old as the oldest: none of them may be late.
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = events.agg(F.max(ts) - F.min(ts)).first()[0] or 0
    X.refresh(X.session_totals(stream, "user_id", "ts", "1 day", sums, late=f"{span + 1} seconds"), f"{path}/table", ["window", "user_id"], f"{path}/log", "user_id", derive, f"{path}/derived")
    return X.current(spark, f"{path}/table")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total, CAST(round(3.3 * count_if(event_type = 'purchase') + count_if(event_type = 'click') - 2 * count_if(event_type = 'error'), 6) AS DOUBLE) AS score FROM events GROUP BY ALL""")
def r1_refresh(spark, sf_dir):
    """User-days from a stream over the landed events, upserted by batch."""
    rows = _user_days(spark, sf_dir, own_folder(spark), 8)
    score = 3.3 * F.col("purchase") + F.col("click") - 2 * F.col("error")
    return rows.select("user_id", F.to_date("window.start").alias("day"), "n", F.round("total", 4).alias("total"), F.round(score, 6).alias("score"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count_if(event_type = 'purchase') AS k FROM events GROUP BY ALL), l AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS last FROM d),
h AS (SELECT user_id, sum(CASE WHEN day >= last - 6 THEN n END) AS cn, sum(CASE WHEN day < last - 6 THEN n END) AS pn, sum(CASE WHEN day >= last - 6 THEN k END) AS ck, sum(CASE WHEN day < last - 6 THEN k END) AS pk FROM l GROUP BY user_id)
SELECT user_id, CAST(cn AS BIGINT) AS current_n, CAST(coalesce(pn, 0) AS BIGINT) AS prior_n, round((cn * (ck / cn) + coalesce(pn * (pk / pn), 0) + 40 * 0.2) / (cn + coalesce(pn, 0) + 40), 6) AS rate FROM h""")
def r1_reblend(spark, sf_dir):
    """The last week of each user blended with the days before and drawn to a prior, made anew for the users that a batch touches."""

    def blended(days):
        day = F.to_date("window.start")
        last = days.groupBy("user_id").agg(F.max(day).alias("last"))
        part = days.join(last, "user_id").withColumn("now", day >= F.date_sub("last", 6))
        sums = {f"{w}_{c}": F.sum(F.when(F.col("now") == (w == "current"), F.col(s))) for w in ("current", "prior") for c, s in (("n", "n"), ("k", "purchase"))}
        two = part.groupBy("user_id").agg(*[v.alias(k) for k, v in sums.items()])
        rates = [(C.safe_ratio(f"{w}_k", f"{w}_n"), F.col(f"{w}_n")) for w in ("current", "prior")]
        rate = C.shrink_two(rates[0][0], rates[0][1], rates[1][0], rates[1][1], 0.2, 40.0)
        return two.select("user_id", "current_n", F.coalesce("prior_n", F.lit(0)).alias("prior_n"), rate.alias("rate"))

    path = own_folder(spark)
    _user_days(spark, sf_dir, path, 6, blended)
    return rounded(X.current(spark, f"{path}/derived"))


@query(f"""{ALL}, s AS (SELECT season FROM panel GROUP BY season HAVING avg(k_pct) > (SELECT avg(k_pct) FROM panel)) SELECT season, count(*) AS n, CAST(count_if(k) AS BIGINT) AS k, round(avg(qty), 6) AS qty FROM ev WHERE season IN (SELECT season FROM s) GROUP BY season""")
def s1_pruned_scan(spark, sf_dir):
    """Events laid out by season and read for the seasons that another table names: which folders are read is decided at run time."""
    path = own_folder(spark)
    S.events(spark, sf_dir).select("season", "k", "qty").repartition("season").write.partitionBy("season").parquet(path)
    by = panel(spark, sf_dir).groupBy("season").agg(F.sum("k_pct").alias("s"), F.count("k_pct").alias("c"))
    whole = by.agg((F.sum("s") / F.sum("c")).alias("m"))
    wanted = R.cut(by.crossJoin(F.broadcast(whole)).select("season", (F.col("s") / F.col("c") > F.col("m")).alias("above")))
    ev = R.scan_seasons(spark, path, wanted.where("above"), ["season", "k", "qty"])
    return rounded(ev.groupBy("season").agg(F.count("*").alias("n"), F.count_if("k").alias("k"), F.avg("qty").alias("qty")))


@query(f"""{ALL}, f AS (SELECT entity, season, round(count_if(swing) / count(*), 6) AS first_rate FROM ev WHERE in_zone AND entity % 3 > 0 GROUP BY ALL)
SELECT p.entity, p.season, n_events, first_rate FROM panel p LEFT JOIN f ON f.entity = p.entity AND f.season = p.season""")
def s6_side_table(spark, sf_dir):
    """A landed side table of some entities merged onto the panel; where it is absent, s2_s5_s6_union_seasons has its column as NULL."""
    path = own_folder(spark)
    side = S.events(spark, sf_dir).where("in_zone and entity % 3 > 0").groupBy("entity", "season").agg(F.round(F.count_if("swing") / F.count("*"), 6).alias("first_rate"))
    side.write.parquet(path)
    return R.join_optional(panel(spark, sf_dir).select("entity", "season", "n_events"), path, ["entity", "season"], R.T.StructType.fromDDL("entity long, season int, first_rate double"))


@query(f"""{ALL}, a AS (SELECT entity, k_pct * 10 AS base FROM panel WHERE season = 2001), b AS (SELECT entity, k_pct * 9 + swing_pct AS high FROM panel WHERE season = 2001 AND k_pct > 0.5), c AS (SELECT entity, hit_pct * 20 AS even FROM panel WHERE season = 2001 AND entity % 2 = 0)
SELECT a.entity, round(base, 6) AS base, round(coalesce(high, base), 6) AS high, round(coalesce(even, base), 6) AS even, round(coalesce(high, base) - base, 6) AS high_delta, round(coalesce(even, base) - base, 6) AS even_delta FROM a LEFT JOIN b USING (entity) LEFT JOIN c USING (entity)""")
def j3_model_outputs(spark, sf_dir):
    """The written outputs of three models side by side on the entities of the first, gaps filled from it, with what they differ by."""
    path = own_folder(spark)
    now = panel(spark, sf_dir).where("season = 2001")
    now.select("entity", (F.col("k_pct") * 10).alias("base")).write.parquet(f"{path}/base")
    now.where("k_pct > 0.5").select("entity", (F.col("k_pct") * 9 + F.col("swing_pct")).alias("high")).write.parquet(f"{path}/high")
    now.where("entity % 2 = 0").select("entity", (F.col("hit_pct") * 20).alias("even")).write.parquet(f"{path}/even")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("base", "high", "even")}
    return rounded(K.side_by_side(tables, "entity"))
