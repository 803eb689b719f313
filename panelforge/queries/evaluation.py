"""Model variants and rules that decide between them, evaluated across seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import comparing as K
from ..operators import held_out as H
from ..operators import linear as L
from ..operators import panel as P
from ..operators import trees as T
from ..operators import windows as W
from ..plans import season as S
from ..session import table
from ..sources.tables import cut
from .base import ALL, panel, rounded
from .modeling import FEATURES, _TOLD, _cells, _held_out_sql, _scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Parts of the score with their weights and the penalty of each part's fit.
PARTS = {"k_per_session": (1.0, 1.0), "ip_per_session": (3.3, 10.0), "hit_per_session": (-1.0, 30.0), "swing_per_session": (-0.5, 100.0)}
PENALTIES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 500.0]

_FIT = "sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w) AS sxy, sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) AS sxx"


def _variant(name: str, more: str) -> str:
    return f"SELECT '{name}' AS variant, {_TOLD} FROM ({more})"


@query(f"""{ALL}, b AS (SELECT entity, season, k_pct AS x, target AS y, k_pct AS k, contact_pct > 0.52 AS contact, avg_qty AS g, k_per_session AS p0, ip_per_session AS p1, hit / n_sessions AS p2, swing / n_sessions AS p3 FROM panel),
h AS (SELECT DISTINCT season AS held FROM b), tr AS (SELECT held, b.* FROM b JOIN h ON b.season < held), big AS (SELECT held FROM tr GROUP BY held HAVING count(*) >= 50),
te AS (SELECT b.season AS held, a.x, a.g, a.contact, b.y, b.k FROM b a JOIN b ON a.entity = b.entity AND b.season = a.season + 1 WHERE b.season IN (SELECT held FROM big)), ok AS (SELECT held FROM te GROUP BY held HAVING count(*) >= 10), t AS (SELECT te.* FROM te JOIN ok USING (held)),
f0 AS (SELECT held, my, mx, sxy / (sxx * (1 + 1 / n)) AS c FROM (SELECT held, {_FIT} FROM (SELECT *, 1.0 AS w FROM tr) GROUP BY held)),
f1 AS (SELECT held, my, mx, sxy / (sxx * (1 + 1 / n)) AS c FROM (SELECT held, {_FIT} FROM (SELECT *, CASE held - season WHEN 1 THEN 5.0 WHEN 2 THEN 4.0 WHEN 3 THEN 3.0 ELSE 1.0 END AS w FROM tr) GROUP BY held)),
f2 AS (SELECT held, side, my, mx, sxy / (sxx * (1 + 1 / n)) AS c FROM (SELECT held, side, {_FIT} FROM (SELECT *, x > 0.5 AS side, 1.0 AS w FROM tr) GROUP BY held, side) WHERE n >= 30),
f3 AS (SELECT held, contact, my, mx, sxy / (sxx * (1 + 1 / n)) AS c FROM (SELECT held, contact, {_FIT} FROM (SELECT *, 1.0 AS w FROM tr WHERE contact) GROUP BY held, contact) WHERE n >= 30),
f4 AS (SELECT held, sum(v * my) AS my, any_value(mx) AS mx, sum(v * sxy / (sxx * (1 + al / n))) AS c FROM (
  {" UNION ALL ".join(f"SELECT held, {v} AS v, {al} AS al, {_FIT} FROM (SELECT held, x, p{i} AS y, 1.0 AS w FROM tr) GROUP BY held" for i, (v, al) in enumerate(PARTS.values()))}) GROUP BY held)
{_variant("base", "SELECT k, y, my + c * (x - mx) AS pred FROM t JOIN f0 USING (held)")} UNION ALL
{_variant("weighted", "SELECT k, y, my + c * (x - mx) AS pred FROM t JOIN f1 USING (held)")} UNION ALL
{_variant("two_tier", "SELECT k, y, coalesce(f2.my + f2.c * (x - f2.mx), f0.my + f0.c * (x - f0.mx)) AS pred FROM t JOIN f0 USING (held) LEFT JOIN f2 ON f2.held = t.held AND f2.side = (x > 0.5)")} UNION ALL
{_variant("contact", "SELECT k, y, coalesce(f3.my + f3.c * (x - f3.mx), f0.my + f0.c * (x - f0.mx)) AS pred FROM t JOIN f0 USING (held) LEFT JOIN f3 ON f3.held = t.held AND f3.contact = t.contact")} UNION ALL
{_variant("components", "SELECT k, y, my + c * (x - mx) AS pred FROM t JOIN f4 USING (held)")}""")
def d1_d2_d3_cross_season(spark, sf_dir):
    """Season weights, two tiers, a contact submodel and the parts of the score, each across seasons, all from one aggregate."""
    p = panel(spark, sf_dir).withColumns({f"{c}_per_session": F.col(c) / F.col("n_sessions") for c in ("hit", "swing")})
    cohorts = {"hi": F.col("k_pct") > 0.5, "lo": F.col("k_pct") < 0.45, "contact": F.col("contact_pct") > 0.52}
    data = H.cells(p, ["k_pct"], "target", cohorts=cohorts, others=list(PARTS))
    x = data.features
    models = {
        "base": H.one_fit(data, x, 1.0),
        "weighted": H.one_fit(data, x, 1.0, weight=lambda season, held: {1: 5, 2: 4, 3: 3}.get(held - season, 1)),
        "two_tier": H.by_cohort(data, x, "hi", 1.0),
        "contact": H.by_cohort(data, x, "contact", 1.0, others_too=False),
        "components": H.components(data, x, [w for w, _ in PARTS.values()], [a for _, a in PARTS.values()]),
    }
    rows = [{"variant": name, **H.evaluate(data, x, "cross_season", model=m)[-1]} for name, m in models.items()]
    return rounded(spark.createDataFrame(rows, "variant string, n long, r double, rmse double, bias double, bias_hi double, bias_lo double"), 4)


@query(f"""{ALL}, b AS (SELECT entity, season, k_pct AS x, target AS y, k_pct AS k, avg_qty AS g FROM panel), h AS (SELECT DISTINCT season AS held FROM b),
f0 AS (SELECT held, my, mx, sxy / (sxx * (1 + 1 / n)) AS c FROM (SELECT held, {_FIT} FROM (SELECT held, x, y, 1.0 AS w FROM b JOIN h ON b.season < held) GROUP BY held) WHERE n >= 50),
te AS (SELECT b.season AS held, a.x, a.g, b.y, b.k FROM b a JOIN b ON a.entity = b.entity AND b.season = a.season + 1), ok AS (SELECT held FROM te GROUP BY held HAVING count(*) >= 10),
p AS (SELECT te.*, my + c * (x - mx) AS base FROM te JOIN f0 USING (held)), al AS (SELECT unnest({PENALTIES}) AS al),
f1 AS (SELECT held, al, my, mx, sxy / (sxx * (1 + al / n)) AS c FROM (SELECT h.held, {_FIT} FROM (SELECT held, g AS x, y - base AS y, 1.0 AS w FROM p) p JOIN h ON p.held < h.held GROUP BY h.held), al WHERE n >= 50),
e AS (SELECT al AS penalty, p.k, p.y, base + coalesce(c * (g - mx) + my, 0) AS pred FROM p JOIN ok USING (held) CROSS JOIN al LEFT JOIN f1 USING (held, al)),
t AS (SELECT CAST(NULL AS DOUBLE) AS penalty, {_TOLD} FROM (SELECT k, y, base AS pred FROM p JOIN ok USING (held)) UNION ALL SELECT penalty, {_TOLD} FROM e GROUP BY penalty)
SELECT *, round(3 * r - 0.5 * abs(bias_hi), 2) AS score FROM t""")
def d4_correction_grid(spark, sf_dir):
    """A correction by a second feature on what the base missed in earlier seasons, for a grid of penalties beside the base alone."""
    data = _cells(spark, sf_dir, ["k_pct", "avg_qty"])
    both = data.features
    rows = [{"penalty": None, **H.evaluate(data, both, "cross_season", model=H.one_fit(data, ["k_pct"], 1.0))[-1]}]
    rows += [{"penalty": a, **H.evaluate(data, both, "cross_season", model=H.corrected(data, ["k_pct"], ["avg_qty"], a, 1.0))[-1]} for a in PENALTIES]
    out = rounded(spark.createDataFrame(rows, "penalty double, n long, r double, rmse double, bias double, bias_hi double, bias_lo double"), 4)
    return out.withColumn("score", F.round(3 * F.col("r") - 0.5 * F.abs("bias_hi"), 2))


@query(f"""{ALL}, {_held_out_sql("a", "k_pct", "hit_pct", True)}
SELECT p.entity, round(my + c1 * (k_pct - m1) + c2 * ((swing * hit_pct + 40 * 0.5) / (swing + 40) - m2), 4) AS pred, round(n.target, 4) AS actual FROM panel p JOIN fia ON held = 2001 LEFT JOIN (SELECT entity, target FROM panel WHERE season = 2001) n ON n.entity = p.entity WHERE p.season = 2000""")
def m16_shrunken_projection(spark, sf_dir):
    """Next season from this one's inputs, a rate among them drawn to its prior by its own sample, by a model of all seasons before."""
    p = panel(spark, sf_dir)
    fit = L.ridge_search(L.moments(p.where("season < 2001"), ["k_pct", "hit_pct"], "target", L.key_fold(5, "entity", "season")))
    now = p.where("season = 2000").withColumn("hit_pct", C.shrink("hit_pct", "swing", 0.5, 40.0))
    actual = p.where("season = 2001").select("entity", F.col("target").alias("actual"))
    return rounded(now.select("entity", fit.predict().alias("pred")).join(actual, "entity", "left"), 4)


@query(f"""{ALL}, {_held_out_sql("a", "k_pct", "swing_pct", True)}, {_held_out_sql("b", "k_pct", "swing_pct", True, "target - 3.3 * ip_per_session")}, v AS (SELECT avg(ip_per_session) AS ip FROM panel WHERE season < 2001)
SELECT entity, round(b.my + b.c1 * (k_pct - b.m1) + b.c2 * (swing_pct - b.m2) + 3.3 * ip, 4) AS stuff, round(a.my + a.c1 * (k_pct - a.m1) + a.c2 * (swing_pct - a.m2) - (b.my + b.c1 * (k_pct - b.m1) + b.c2 * (swing_pct - b.m2) + 3.3 * ip), 4) AS premium
FROM panel, v, fia a, fib b WHERE season = 2001 AND a.held = 2001 AND b.held = 2001""")
def m19_fitted_parts(spark, sf_dir):
    """The target without its volume, fitted, at the mean volume of earlier seasons, and what the whole target's fit has beyond it."""
    from ..operators import blending as B

    p = panel(spark, sf_dir).withColumn("rest", F.col("target") - 3.3 * F.col("ip_per_session"))
    past = p.where("season < 2001")
    by = L.moments_of(past, ["k_pct", "swing_pct"], ["target", "rest"], L.key_fold(5, "entity", "season"))
    full, rest = (L.ridge_search(by[t]).predict() for t in ("target", "rest"))
    return rounded(B.decomposed(p.where("season = 2001"), full, rest, "ip_per_session", 3.3, past).select("entity", "stuff", "premium"), 4)


_METRICS = ["k", "hit", "swing", "n", "ip"]
_ROLLED = ", ".join(f"CASE WHEN count({m}) OVER w >= 2 THEN avg({m}) OVER w END AS {m}_last5" for m in _METRICS)


@query(f"""{ALL}, ro AS (SELECT entity, season, session, score, {_ROLLED} FROM se WINDOW w AS (PARTITION BY entity ORDER BY season, session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
ml AS ({" UNION ALL ".join(f"SELECT '{m}_last5' AS metric, {m}_last5 AS v, score FROM ro WHERE season = 2000" for m in _METRICS)}),
best AS (SELECT metric, sign(r) AS s FROM (SELECT metric, corr(v, score) AS r FROM ml GROUP BY metric HAVING count(CASE WHEN v IS NOT NULL THEN 1 END) >= 30) WHERE r IS NOT NULL ORDER BY r DESC, metric LIMIT 3),
la AS (SELECT * FROM ro WHERE season = 2001 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY session DESC) = 1),
lo AS (SELECT entity, metric, v, s FROM ({" UNION ALL ".join(f"SELECT entity, '{m}_last5' AS metric, {m}_last5 AS v FROM la" for m in _METRICS)}) JOIN best USING (metric)),
fu AS (SELECT entity FROM lo GROUP BY entity HAVING count(v) = (SELECT count(*) FROM best)), st AS (SELECT metric, avg(v) AS m, stddev_pop(v) AS d FROM lo JOIN fu USING (entity) GROUP BY metric),
sc AS (SELECT entity, avg(s * (v - m) / nullif(d, 0)) AS score FROM lo JOIN fu USING (entity) JOIN st USING (metric) GROUP BY entity)
SELECT entity, round(score, 5) AS score, CASE WHEN score > m + 0.75 * d THEN 'HIGH' WHEN score < m - 0.75 * d THEN 'LOW' ELSE 'NORMAL' END AS trend FROM sc, (SELECT avg(score) AS m, stddev_samp(score) AS d FROM sc)""")
def m21_chosen_trend(spark, sf_dir):
    """The three rolling metrics that went best with the score of the season before, as one signed trend of each entity's latest session."""
    se = S.sessions(S.events(spark, sf_dir))
    names = [f"{m}_last5" for m in _METRICS]
    ro = se.withColumns({f"{m}_last5": W.rolling_mean(m, "entity", ["season", "session"], 5, 2) for m in _METRICS})
    ranking = K.predictor_table(ro.where("season = 2000").withColumn("later", F.lit(None).cast("double")), names, "score", "later")
    latest = W.latest(ro.where("season = 2001"), "entity", "session").select("entity", *names)
    out = K.composite_trend(latest, ["entity"], names, K.best_predictors(ranking))
    return rounded(out, 5)


@query(f"""{ALL}, c AS (SELECT *, k_pct * 10 AS o, k_pct * 9 + swing_pct AS w FROM panel WHERE season = 2001 AND n_sessions >= 5 ORDER BY round(k_pct, 9) DESC, entity LIMIT 25)
SELECT count(*) AS n, round(avg(w - o), 6) AS mean_delta, round(median(w - o), 6) AS median_delta, round(stddev_samp(w - o), 6) AS std_delta, round(corr(w - o, k_pct), 6) AS delta_by_corr,
round(avg(abs(o - target)), 6) AS mae_old, round(avg(abs(w - target)), 6) AS mae_new, round(corr(o, target), 6) AS r_old, round(corr(w, target), 6) AS r_new, CAST(count_if(abs(w - o) > 0.5) AS BIGINT) AS movers FROM c""")
def m22_cohort_check(spark, sf_dir):
    """Two models over the 25 entities with the highest rate of the season."""
    now = _scored(spark, sf_dir).where("season = 2001 AND n_sessions >= 5")
    return rounded(K.spot_check(now.orderBy(F.desc(F.round("k_pct", 9)), "entity").limit(25), "target", "old", "new", "k_pct"))


_MARKS = {"#000000007": 3.0, "#000000003": 4.0}


@query(f"""{ALL}, c AS (SELECT *, k_pct * 10 AS o, k_pct * 9 + swing_pct AS w FROM panel LEFT JOIN supplier ON s_suppkey = entity WHERE season = 2001),
d AS (SELECT corr(o, target) AS ro, corr(w, target) AS rw, {", ".join(f"coalesce(arg_min(CASE WHEN contains(s_name, '{n}') THEN w END, CASE WHEN contains(s_name, '{n}') THEN s_name END) > {m}, false) AS p{i}" for i, (n, m) in enumerate(_MARKS.items()))} FROM c)
SELECT round(ro, 4) AS r_old, round(rw, 4) AS r_new, coalesce(rw >= ro - 0.005, false) AS pass_r, p0 AND p1 AS pass_named, CASE WHEN rw >= ro - 0.005 AND p0 AND p1 THEN 'PASS' ELSE 'PARTIAL' END AS decision FROM d""")
def m14_pass_rule(spark, sf_dir):
    """A new model passes if it correlates no worse and named entities stand as high as they must."""
    now = P.named(_scored(spark, sf_dir).where("season = 2001"), table(spark, sf_dir, "supplier"), "entity", "s_suppkey", "s_name")
    return rounded(K.ship_decision(now, "target", "old", "new", F.col("name"), _MARKS), 4)


@query(f"""{ALL}, m AS (SELECT p.*, ln(avg_disc) AS log_disc, CASE WHEN season = 1996 AND entity % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE k_pct / swing_pct END AS ratio FROM panel p JOIN supplier ON s_suppkey = entity),
o AS (SELECT 1 - (SELECT count(*) FROM m) / (SELECT count(*) FROM panel) AS lost, (SELECT count_if(isnan(ratio) OR isinf(ratio)) FROM m) AS odd)
SELECT 'lost' AS "check", round(lost, 6) AS observed, CAST(-1e12 AS DOUBLE) AS least, CAST(0.15 AS DOUBLE) AS most, lost <= 0.15 AS passed FROM o UNION ALL SELECT 'odd', CAST(odd AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), odd = 0 FROM o""")
def d13_merge_guards(spark, sf_dir):
    """After a join with the suppliers and a derived ratio that is NaN in places: rows lost, and values that are no numbers."""
    before = panel(spark, sf_dir)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))
    bad = F.when((F.col("season") == 1996) & (F.col("entity") % 5 == 0), F.lit(float("nan"))).otherwise(F.col("k_pct") / F.col("swing_pct"))
    after = before.join(names, "entity").withColumns({"log_disc": F.ln("avg_disc"), "ratio": bad})
    return rounded(K.merge_guards(before, after))


@query(f"""{ALL}, o AS (SELECT k_pct AS v FROM panel WHERE entity = 3 AND season = 2000) SELECT 'k_pct' AS "check", round((SELECT v FROM o), 6) AS observed, CAST(0.3 AS DOUBLE) AS least, CAST(0.7 AS DOUBLE) AS most, coalesce((SELECT v FROM o) BETWEEN 0.3 AND 0.7, false) AS passed""")
def m27_entity_check(spark, sf_dir):
    """Whether one entity's value of one season is where it is known to be; an absent row doesn't pass."""
    seen = panel(spark, sf_dir).where("entity = 3 AND season = 2000").agg(F.max("k_pct").alias("k_pct"))
    return rounded(K.checks(seen, {"k_pct": (0.3, 0.7)}))


#: Seasons held out, and trees of a fit: fewer than a full fit's 500 and 300, for time.
HELD_OUT, TREES = [1998, 1999, 2000, 2001], {"forest": 20, "boosted": 20}


@query()
def m8_held_out_trees(spark, sf_dir):
    """Both ensembles out of season and across seasons beside the ridge fit of the same seasons, with how far they are ahead."""
    p = cut(panel(spark, sf_dir).select("entity", "season", *FEATURES, "target"))
    data = _cells(spark, sf_dir, FEATURES, p=p)
    ridge = {m: H.evaluate(data, FEATURES, m, seasons=HELD_OUT)[-1]["r"] for m in ("out_of_season", "cross_season")}
    rows = T.held_out(p, FEATURES, "target", HELD_OUT, TREES, cohort=F.col("k_pct") > 0.5)
    for r in rows:
        both = r["r"] is not None and ridge[r["mode"]] is not None
        r |= {"ridge_r": ridge[r["mode"]], "gap": r["r"] - ridge[r["mode"]] if both else None, "gap_class": T.gap_class(r["r"], ridge[r["mode"]]) if both else None}
    return spark.createDataFrame(rows, "mode string, model string, trees int, n long, r double, rmse double, bias double, bias_hi double, ridge_r double, gap double, gap_class string")


#: Feature sets of two at most: what is added to the first one, what takes its place, and named sets with polynomials.
SETS = [("base", "k_pct", None), ("add", "k_pct", "swing_pct"), ("add", "k_pct", "hit_pct"), ("add", "k_pct", "zone_pct"), ("swap", "swing_pct", None), ("swap", "avg_qty", None), ("named", "hit_pct", "zone_pct"), ("polynomial", "k_pct", "log_k"), ("polynomial", "k_pct", "k_sq")]
_DERIVED = {"log_k": "ln(k_pct + 1)", "k_sq": "k_pct * k_pct"}


def _nested_sql(tag: str, x1: str, x2: str | None) -> str:
    """CTEs that end in ``e{tag}``: each of five folds predicted by a fit on the others, which choose its penalty among themselves."""
    cte = _held_out_sql(tag, _DERIVED.get(x1, x1), _DERIVED.get(x2, x2) if x2 else "0", False)
    cte = cte.replace("(SELECT DISTINCT season AS held FROM", "(SELECT DISTINCT fold AS held FROM").replace("b.season <> h.held", "b.fold <> h.held")
    return cte.replace("SELECT season AS held, x1, x2, y, k FROM", "SELECT fold AS held, x1, x2, y, k FROM")


_SCORES = " UNION ALL ".join(
    f"SELECT {i} AS nr, '{kind}' AS kind, '{','.join(f for f in (a, b) if f)}' AS features, sqrt(greatest(avg(r2), 0)) AS score FROM (SELECT 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM e{i} GROUP BY season)"
    for i, (kind, a, b) in enumerate(SETS)
)


@query(f"""{ALL}, {", ".join(_nested_sql(str(i), a, b) for i, (_, a, b) in enumerate(SETS))}, s AS ({_SCORES})
SELECT kind, features, round(score, 4) AS score, round(score - (SELECT score FROM s WHERE nr = 0), 4) AS gain FROM s""")
def m5_m10_m11_m12_m24_nested(spark, sf_dir):
    """Nested five-fold scores of single additions, replacements, named sets and polynomials, all from one aggregate."""
    names = list(dict.fromkeys(f for _, a, b in SETS for f in (a, b) if f))
    p = panel(spark, sf_dir).withColumns({"log_k": F.ln(F.col("k_pct") + 1), "k_sq": F.col("k_pct") * F.col("k_pct")})
    folds = L.moments(p, names, "target", L.key_fold(5, "entity", "season"))
    scores = [L.k_fold_score({k: m.only([f for f in (a, b) if f]) for k, m in folds.items()}) for _, a, b in SETS]
    rows = [(kind, ",".join(f for f in (a, b) if f), score, score - scores[0]) for (kind, a, b), score in zip(SETS, scores)]
    return rounded(spark.createDataFrame(rows, "kind string, features string, score double, gain double"), 4)


@query(f"""{ALL}, {_held_out_sql("a", "k_pct", "swing_pct", True)}, f AS (SELECT fia.*, d1, d2 FROM fia JOIN sca USING (held) WHERE held = 9999)
SELECT 'k_pct' AS feature, round(c1, 4) AS coefficient, round(c1 * d1, 4) AS standardized, round(a, 4) AS alpha FROM f UNION ALL SELECT 'swing_pct', round(c2, 4), round(c2 * d2, 4), round(a, 4) FROM f""")
def m15_coefficients(spark, sf_dir):
    """Coefficients and standardized ones of two features under the penalty that five folds choose."""
    fit = L.ridge_search(L.moments(panel(spark, sf_dir), ["k_pct", "swing_pct"], "target", L.key_fold(5, "entity", "season")))
    rows = [(f, float(c), float(s), fit.alpha) for f, c, s in zip(fit.features, fit.coefficients, fit.standardized)]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double, standardized double, alpha double"), 4)
