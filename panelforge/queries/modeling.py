"""Fits, evaluations, searches, blends and comparisons."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.scalars import correlation
from ..operators import blending as B
from ..operators import comparing as K
from ..operators import held_out as H
from ..operators import linear as L
from ..operators import panel as P
from ..operators import trees as T
from ..operators import windows as W
from ..plans import season as S
from ..sources.tables import cut
from .base import ALL, panel, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ["k_pct", "swing_pct", "hit_pct", "zone_pct", "avg_qty"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _coef(rows: str, alpha: float, by: str = "1") -> str:
    """Closed-form ridge of target on k_pct over ``rows``, by group, as SQL."""
    return f"""SELECT {by} AS g, (sum((k_pct - xm) * (target - ym)) / sd) / (n + {alpha}) / sd AS c, any_value(ym) - (sum((k_pct - xm) * (target - ym)) / sd) / (n + {alpha}) / sd * any_value(xm) AS i
FROM (SELECT *, avg(k_pct) OVER (PARTITION BY {by}) AS xm, avg(target) OVER (PARTITION BY {by}) AS ym, stddev_pop(k_pct) OVER (PARTITION BY {by}) AS sd, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})) GROUP BY {by}, sd, n"""


def _scored(spark, sf_dir):
    """Predictions of two fixed models beside the panel."""
    p = panel(spark, sf_dir)
    return p.withColumns({"old": F.col("k_pct") * 10, "new": F.col("k_pct") * 9 + F.col("swing_pct")})


@query(f"""{ALL}, f AS ({_coef("SELECT * FROM panel", 10)}) SELECT round(c, 4) AS coefficient, round(i, 4) AS intercept FROM f""")
def a18_m1_m2_ridge(spark, sf_dir):
    fit = L.solve(L.total(list(L.moments(panel(spark, sf_dir), ["k_pct"], "target", "season").values())), 10.0)
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 4), round(fit.intercept, 4))], "coefficient double, intercept double")


@query(f"""{ALL}, h AS (SELECT DISTINCT season AS held FROM panel), f AS ({_coef("SELECT p.*, held FROM panel p JOIN h ON p.season <> h.held", 1, "held")}), e AS (SELECT season, target, k_pct, i + c * k_pct AS pred FROM panel JOIN f ON season = g)
SELECT season, count(*) AS n, round(corr(pred, target), 4) AS r, round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse, round(avg(target - pred), 4) AS bias, round(avg(CASE WHEN k_pct > 0.5 THEN target - pred END), 4) AS cohort_bias,
(SELECT round(corr(pred, target), 4) FROM e) AS pooled_r FROM e GROUP BY season""")
def m3_out_of_season(spark, sf_dir):
    """Every season held out in turn, with the correlation of all predictions together; one scan."""
    *rows, last = H.evaluate(_cells(spark, sf_dir, ["k_pct"]), ["k_pct"], alpha=1.0, least_test=1)
    out = [(r["season"], r["n"], r["r"], r["rmse"], r["bias"], r["bias_hi"], last["r"]) for r in rows]
    return rounded(spark.createDataFrame(out, "season int, n long, r double, rmse double, bias double, cohort_bias double, pooled_r double"), 4)


@query(f"""{ALL}, h AS (SELECT DISTINCT season AS held FROM panel), f AS ({_coef("SELECT p.*, held FROM panel p JOIN h ON p.season < h.held", 1, "held")} HAVING any_value(n) >= 50), e AS (SELECT b.season AS to_season, b.target, i + c * a.k_pct AS pred FROM panel a JOIN panel b ON a.entity = b.entity AND b.season = a.season + 1 JOIN f ON g = b.season)
SELECT to_season, count(*) AS n, round(corr(pred, target), 4) AS r, round(sqrt(avg((pred - target) * (pred - target))), 4) AS rmse, round(avg(target - pred), 4) AS bias, (SELECT round(corr(pred, target), 4) FROM e) AS pooled_r FROM e GROUP BY to_season""")
def m4_cross_season(spark, sf_dir):
    """A season's target from the season before, by models of all seasons before it; one scan."""
    *rows, last = H.evaluate(_cells(spark, sf_dir, ["k_pct"]), ["k_pct"], "cross_season", alpha=1.0, least_test=1)
    out = [(r["season"], r["n"], r["r"], r["rmse"], r["bias"], last["r"]) for r in rows]
    return rounded(spark.createDataFrame(out, "to_season int, n long, r double, rmse double, bias double, pooled_r double"), 4)


def _held_out_sql(tag: str, x1: str, x2: str, ahead: bool, y: str = "target") -> str:
    """CTEs that end in ``e{tag}``: predictions by ridge on two features, the penalty chosen a held-out season by five folds, as SQL.

    A second feature of 0 has no weight; rows lacking a feature are left out.
    """
    on = "b.season < h.held" if ahead else "b.season <> h.held"
    test = f"SELECT b.season AS held, a.x1, a.x2, b.y, b.k FROM base{tag} a JOIN base{tag} b ON a.entity = b.entity AND b.season = a.season + 1" if ahead else f"SELECT season AS held, x1, x2, y, k FROM base{tag}"
    solved = """(coalesce(q11 / (d1 * d1), 0) + a) * (coalesce(q22 / nullif(d2 * d2, 0), 0) + a) - coalesce(q12 / nullif(d1 * d2, 0), 0) * coalesce(q12 / nullif(d1 * d2, 0), 0) AS det,
      q1y / d1 AS g1, coalesce(q2y / nullif(d2, 0), 0) AS g2, q11 / (d1 * d1) + a AS h11, coalesce(q22 / nullif(d2 * d2, 0), 0) + a AS h22, coalesce(q12 / nullif(d1 * d2, 0), 0) AS h12"""
    weights = "(g1 * h22 - g2 * h12) / det / d1 AS c1, coalesce((g2 * h11 - g1 * h12) / det / nullif(d2, 0), 0) AS c2, abs((g1 * h22 - g2 * h12) / det) AS w1, abs((g2 * h11 - g1 * h12) / det) AS w2"
    sums = "avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) * count(*) AS q11, covar_pop(x1, x2) * count(*) AS q12, covar_pop(x2, x2) * count(*) AS q22, covar_pop(x1, y) * count(*) AS q1y, covar_pop(x2, y) * count(*) AS q2y"
    return f"""base{tag} AS (SELECT entity, season, (entity * 31 + season) % 5 AS fold, {x1} AS x1, CAST({x2} AS DOUBLE) AS x2, {y} AS y, k_pct AS k FROM panel),
full{tag} AS (SELECT * FROM base{tag} WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
tr{tag} AS (SELECT h.held, b.* FROM full{tag} b JOIN (SELECT DISTINCT season AS held FROM base{tag}{" UNION ALL SELECT 9999" if ahead else ""}) h ON {on}),
sc{tag} AS (SELECT held, count(*) AS n, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, {sums} FROM tr{tag} GROUP BY held HAVING count(*) >= 50),
al{tag} AS (SELECT i, pow(10, -1 + 6.0 * i / 79) AS a FROM range(80) t(i)),
fo{tag} AS (SELECT held, k.fold, {sums} FROM tr{tag} t JOIN (SELECT unnest(range(5)) AS fold) k ON t.fold <> k.fold GROUP BY held, k.fold),
co{tag} AS (SELECT held, fold, i, a, m1, m2, my, {weights} FROM (SELECT f.*, i, a, d1, d2, {solved} FROM fo{tag} f JOIN (SELECT held, d1, d2 FROM sc{tag}) USING (held), al{tag})),
r2{tag} AS (SELECT c.held, c.fold, i, a, 1 - sum((y - my - c1 * (x1 - m1) - c2 * (x2 - m2)) * (y - my - c1 * (x1 - m1) - c2 * (x2 - m2))) / (var_pop(y) * count(*)) AS r2 FROM co{tag} c JOIN tr{tag} t ON t.held = c.held AND t.fold = c.fold GROUP BY c.held, c.fold, i, a),
be{tag} AS (SELECT held, a FROM r2{tag} GROUP BY held, i, a QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(avg(r2), 12) DESC, i) = 1),
fi{tag} AS (SELECT held, n, a, m1, m2, my, {weights} FROM (SELECT sc{tag}.*, a, {solved} FROM sc{tag} JOIN be{tag} USING (held))),
te{tag} AS (SELECT * FROM ({test}) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
ok{tag} AS (SELECT held FROM te{tag} GROUP BY held HAVING count(*) >= 10),
e{tag} AS (SELECT held AS season, a AS alpha, k, y, my + c1 * (x1 - m1) + c2 * (x2 - m2) AS pred FROM te{tag} JOIN ok{tag} USING (held) JOIN fi{tag} USING (held))"""


_TOLD = "count(*) AS n, round(corr(pred, y), 4) AS r, round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse, round(avg(y - pred), 4) AS bias, round(avg(CASE WHEN k > 0.5 THEN y - pred END), 4) AS bias_hi, round(avg(CASE WHEN k < 0.45 THEN y - pred END), 4) AS bias_lo"


@query(f"""{ALL}, {_held_out_sql("a", "k_pct", "swing_pct", False)}, {_held_out_sql("b", "k_pct", "swing_pct", True)}
SELECT 'out_of_season' AS mode, season, round(any_value(alpha), 4) AS alpha, {_TOLD} FROM ea GROUP BY season UNION ALL SELECT 'out_of_season', NULL, NULL, {_TOLD} FROM ea UNION ALL
SELECT 'cross_season', season, round(any_value(alpha), 4), {_TOLD} FROM eb GROUP BY season UNION ALL SELECT 'cross_season', NULL, NULL, {_TOLD} FROM eb""")
def m3_m4_chosen_penalty(spark, sf_dir):
    """Both evaluations with two features, the penalty chosen anew for every held-out season, and pooled rows without a season."""
    data = _cells(spark, sf_dir, ["k_pct", "swing_pct"])
    rows = [{"mode": m, **r} for m in ("out_of_season", "cross_season") for r in H.evaluate(data, data.features, m)]
    return rounded(spark.createDataFrame(rows, "mode string, season int, alpha double, n long, r double, rmse double, bias double, bias_hi double, bias_lo double"), 4)


@query()
def m3_m4_feature_sets(spark, sf_dir):
    """Both evaluations of every named feature set, all from one aggregate over the panel."""
    names = list(dict.fromkeys(f for _, fs in COMBINATIONS.values() for f in fs))
    data = _cells(spark, sf_dir, names)
    rows = [{"mode": m, "name": name, "features": ",".join(fs), **H.evaluate(data, fs, m)[-1]} for name, (_, fs) in COMBINATIONS.items() for m in ("out_of_season", "cross_season")]
    return rounded(spark.createDataFrame(rows, "mode string, name string, features string, n long, r double, rmse double, bias double, bias_hi double, bias_lo double"), 4)


_GAPPY = "CASE WHEN contact_pct > 0.52 THEN NULL ELSE hit_pct END"


@query(f"""{ALL}, {_held_out_sql("a", "k_pct", _GAPPY, True)}, {_held_out_sql("b", "k_pct", "0", True)}, {_held_out_sql("c", _GAPPY, "0", True)},
s AS (SELECT 0 AS step, 'k_pct,hit_some' AS features, {_TOLD} FROM ea UNION ALL SELECT 1, 'k_pct', {_TOLD} FROM eb UNION ALL SELECT 1, 'hit_some', {_TOLD} FROM ec),
first AS (SELECT CASE WHEN w1 < w2 THEN 'k_pct' ELSE 'hit_some' END AS dropped, CAST(n AS BIGINT) AS n_rows FROM fia WHERE held = 9999),
steps AS (SELECT s.*, first.dropped, first.n_rows FROM s, first WHERE step = 0 UNION ALL
  SELECT s.*, s.features, CASE WHEN s.features = 'k_pct' THEN (SELECT n FROM fib WHERE held = 9999) ELSE (SELECT n FROM fic WHERE held = 9999) END FROM s, first WHERE step = 1 AND s.features <> first.dropped)
SELECT step, features, CAST(n_rows AS BIGINT) AS n_rows, dropped, n, r, rmse, bias, bias_hi, bias_lo, round(3 * r - 0.5 * abs(bias_hi), 2) AS score, coalesce(step = (SELECT min(step) FROM steps WHERE 3 * r - 0.5 * abs(bias_hi) = (SELECT max(3 * r - 0.5 * abs(bias_hi)) FROM steps)), false) AS best FROM steps""")
def m9_two_features(spark, sf_dir):
    """Elimination from two features, one of which many rows lack, down to one, scored across seasons."""
    some = F.when(F.col("contact_pct") > 0.52, None).otherwise(F.col("hit_pct"))
    data = _cells(spark, sf_dir, ["k_pct", "hit_some"], {"hit_some": some})
    rows = H.eliminate(data, data.features, _cross_score, least_features=0, least_rows=50)
    return rounded(spark.createDataFrame(rows, _ELIMINATION), 4).withColumn("score", F.round("score", 2))


_ELIMINATION = "step int, features string, n_rows long, dropped string, n long, r double, rmse double, bias double, bias_hi double, bias_lo double, score double, best boolean"


def _cross_score(row: dict) -> float | None:
    """Three times the correlation less half the bias of the high cohort; none where there is no correlation."""
    return None if row["r"] is None else 3 * row["r"] - 0.5 * abs(row["bias_hi"] or 0.0)


def _cells(spark, sf_dir, features, extra=None, p=None):
    p = (panel(spark, sf_dir) if p is None else p).withColumns(extra or {})
    return H.cells(p, features, "target", cohorts={"hi": F.col("k_pct") > 0.5, "lo": F.col("k_pct") < 0.45}, fold=L.key_fold(5, "entity", "season"))


@query()
def m9_backward_elimination(spark, sf_dir):
    """From eight features, two of which some rows lack, until four are left: each set scored across seasons from one aggregate."""
    extra = {"hit_some": F.when(F.col("contact_pct") > 0.6, None).otherwise(F.col("hit_pct")), "log_price": F.ln("avg_price"), "k_sq": F.col("k_pct") ** 2}
    data = _cells(spark, sf_dir, [*FEATURES, *extra], extra)
    return rounded(spark.createDataFrame(H.eliminate(data, data.features, _cross_score), _ELIMINATION), 6)


@query(f"""{ALL}, h AS (SELECT DISTINCT season AS held FROM panel), f AS ({_coef("SELECT p.*, held FROM panel p JOIN h ON p.season <> h.held", 1, "held")}), e AS (SELECT entity, season, target - i - c * k_pct AS residual FROM panel JOIN f ON season = g)
SELECT entity, season, round(residual, 4) AS residual, round(lag(residual) OVER (PARTITION BY entity ORDER BY season), 4) AS residual_lag1 FROM e""")
def m7_residual_lag(spark, sf_dir):
    out = L.season_residual(panel(spark, sf_dir), ["k_pct"], "target", alpha=1.0)
    return rounded(W.lags(out, "entity", ["season"], ["residual"], [1]).select("entity", "season", "residual", "residual_lag1"), 4)


@query(f"""{ALL} SELECT count(*) AS n, round(corr(k_pct * 10, target), 4) AS r, round(avg(target - k_pct * 10), 6) AS bias, round(avg(CASE WHEN k_pct > 0.5 THEN target - k_pct * 10 END), 6) AS cohort_bias, round(avg(n_sessions), 6) AS sessions FROM panel WHERE season = 2001 AND n_sessions >= 5""")
def m6_in_season(spark, sf_dir):
    now = _scored(spark, sf_dir).where("season = 2001 AND n_sessions >= 5")
    out = now.agg(*L.metrics("target", "old", F.col("k_pct") > 0.5), F.avg("n_sessions").alias("sessions")).drop("rmse", "mae")
    return rounded(out.withColumn("r", F.round("r", 4)))


def _folds(spark, sf_dir, features=FEATURES, k: int = 5):
    return L.moments(panel(spark, sf_dir), features, "target", L.hash_fold(k, "entity", "season"))


@query()
def m2_m15_ridge_search(spark, sf_dir):
    fit = L.ridge_search(_folds(spark, sf_dir))
    rows = [(f, float(c), float(s), fit.alpha) for f, c, s in zip(fit.features, fit.coefficients, fit.standardized)]
    return spark.createDataFrame(rows, "feature string, coefficient double, standardized double, alpha double").orderBy(F.desc(F.abs("standardized")))


_SEARCH = """f AS (SELECT (entity * 31 + season) % 5 AS fold, k_pct AS x, target AS y FROM panel), al AS (SELECT i, pow(10, -1 + 6.0 * i / 79) AS a FROM range(80) t(i)), s AS (SELECT stddev_pop(x) AS sd, avg(x) AS xa, avg(y) AS ya, covar_pop(x, y) * count(*) AS xy, count(*) AS n FROM f),
tr AS (SELECT h.fold, avg(x) AS xm, avg(y) AS ym, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM f JOIN (SELECT DISTINCT fold FROM f) h ON f.fold <> h.fold GROUP BY h.fold),
co AS (SELECT fold, i, a, sxy / sd / (sxx / (sd * sd) + a) / sd AS c, xm, ym FROM tr, al, s),
sc AS (SELECT i, a, 1 - sum((y - ym - c * (x - xm)) * (y - ym - c * (x - xm))) / (var_pop(y) * count(*)) AS r2 FROM co JOIN f USING (fold) GROUP BY fold, i, a),
best AS (SELECT a FROM sc GROUP BY i, a ORDER BY round(avg(r2), 12) DESC, i LIMIT 1)"""


@query(f"""{ALL}, {_SEARCH} SELECT round(a, 4) AS alpha, round(xy / sd / (n + a) / sd, 4) AS coefficient, round(ya - xy / sd / (n + a) / sd * xa, 4) AS intercept FROM best, s""")
def m2_penalty_search(spark, sf_dir):
    """The penalty that five folds choose among eighty, and the fit with it, on one feature."""
    fit = L.ridge_search(L.moments(panel(spark, sf_dir), ["k_pct"], "target", L.key_fold(5, "entity", "season")))
    return spark.createDataFrame([(round(fit.alpha, 4), round(float(fit.coefficients[0]), 4), round(fit.intercept, 4))], "alpha double, coefficient double, intercept double")


#: Named sets of features, with the tag that says whether a set looks at the target's own season.
COMBINATIONS = {"rates": ("clean", ["k_pct", "swing_pct", "hit_pct"]), "volume": ("clean", ["avg_qty", "zone_pct"]), "rates_volume": ("clean", FEATURES), "depth": ("semi_circular", ["k_pct", "ip_per_session"])}


@query()
def m12_combinations(spark, sf_dir):
    """Nested cross-validation of named feature sets, all from one aggregate."""
    names = list(dict.fromkeys(f for _, fs in COMBINATIONS.values() for f in fs))
    folds = _folds(spark, sf_dir, names, 10)
    rows = [(name, tag, ",".join(fs), L.k_fold_score({k: m.only(fs) for k, m in folds.items()})) for name, (tag, fs) in COMBINATIONS.items()]
    return spark.createDataFrame(rows, "name string, tag string, features string, score double").orderBy(F.desc("score"), "name")


@query(f"""{ALL}, t AS (SELECT entity, k_pct, k_pct * 10 AS o, k_pct * 9 + swing_pct AS w, target FROM panel WHERE season = 2001 ORDER BY target DESC, entity LIMIT 25)
SELECT entity, round(o, 6) AS old, round(w, 6) AS new, round(w - o, 6) AS delta, round(target, 6) AS target FROM t WHERE abs(w - o) > 0.5""")
def m22_top_movers(spark, sf_dir):
    """Of the 25 entities with the best target of the season those that two models see more than half a point apart."""
    now = _scored(spark, sf_dir).where("season = 2001").select("entity", "old", "new", "target")
    return rounded(K.movers(now, "target", "entity", "old", "new", 25, 0.5))


@query()
def m5_m10_m11_m12_screen(spark, sf_dir):
    folds = _folds(spark, sf_dir, k=10)
    rows = L.screen(folds, FEATURES[:2], FEATURES[2:]) + L.replacements(folds, FEATURES[:2], FEATURES[2:])
    return spark.createDataFrame(rows, "kind string, feature string, score double, gain double").orderBy(F.desc("score"), "feature")


@query()
def m9_elimination(spark, sf_dir):
    return spark.createDataFrame(L.eliminate(_folds(spark, sf_dir), FEATURES), "step int, features string, score double")


@query()
def m24_polynomials(spark, sf_dir):
    p = S.derived(panel(spark, sf_dir)).withColumns({"log_k": F.ln(F.col("k_pct") + 1), "sq_k": F.col("k_pct") ** 2})
    folds = L.moments(p, ["k_pct", "swing_pct", "log_k", "sq_k"], "target", L.hash_fold(5, "entity", "season"))
    return spark.createDataFrame(L.screen(folds, ["k_pct", "swing_pct"], ["log_k", "sq_k"]), "kind string, feature string, score double, gain double")


_CONFIGS = """cfg AS (SELECT 'season ' || season AS config, CASE WHEN season < 1999 THEN 'early' ELSE 'late' END AS dataset, round(corr(k_pct, target), 4) AS r, round(avg(CASE WHEN k_pct > 0.5 THEN target - k_pct * 10 END), 4) AS k_bias FROM panel GROUP BY season)"""
_FORMULAS = {
    "linear_050": "3 * r - 0.5 * abs(k_bias)", "linear_025": "3 * r - 0.25 * abs(k_bias)", "linear_010": "3 * r - 0.1 * abs(k_bias)", "linear_100": "3 * r - abs(k_bias)",
    "tolerance_050": "3 * r - 0.5 * greatest(abs(k_bias) - 0.5, 0)", "tolerance_070": "3 * r - 0.5 * greatest(abs(k_bias) - 0.7, 0)", "tolerance_100": "3 * r - 0.5 * greatest(abs(k_bias) - 1.0, 0)",
    "quadratic_050": "3 * r - 0.5 * k_bias * k_bias", "quadratic_025": "3 * r - 0.25 * k_bias * k_bias", "floored": "3 * r + 0.5 * greatest(0.21 - abs(k_bias), 0)",
}
_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT config, dataset, r, k_bias, '{n}' AS formula, round({e}, 5) AS score FROM cfg" for n, e in _FORMULAS.items()) + ")"


def _configs(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = p.groupBy("season").agg(F.round(correlation("k_pct", "target"), 4).alias("r"), F.round(F.avg(F.when(F.col("k_pct") > 0.5, F.col("target") - F.col("k_pct") * 10)), 4).alias("k_bias"))
    return out.select(F.concat(F.lit("season "), F.col("season").cast("string")).alias("config"), F.when(F.col("season") < 1999, "early").otherwise("late").alias("dataset"), "r", "k_bias")


@query(f"""{ALL}, {_CONFIGS}, {_LONG} SELECT *, CAST(rank() OVER (PARTITION BY dataset, formula ORDER BY score DESC) AS INT) AS rank FROM lng""")
def c10_j13_w8_m23_formulas(spark, sf_dir):
    return K.formula_sensitivity(_configs(spark, sf_dir))


@query(f"""{ALL}, {_CONFIGS}, {_LONG} SELECT dataset, formula, max(score) AS score, min(config) AS winner FROM (SELECT *, max(score) OVER (PARTITION BY dataset, formula) AS top FROM lng) WHERE score = top GROUP BY dataset, formula""")
def a15_winners(spark, sf_dir):
    return K.winners(K.formula_sensitivity(_configs(spark, sf_dir)), "config")


@query(f"""{ALL}, {_CONFIGS} SELECT config, r, k_bias, round(3 * r - 0.5 * abs(k_bias), 6) AS score, coalesce(3 * r - 0.5 * abs(k_bias) - 0.5 >= 0.01, false) AS ships FROM cfg""")
def m13_m14_leaderboard(spark, sf_dir):
    return rounded(K.leaderboard(_configs(spark, sf_dir), k="k_bias", incumbent=0.5).drop("dataset"))


_PAIR = """pr AS (SELECT coalesce(a.entity, b.entity) AS entity, a.n_events AS pn, b.n_events AS cn, a.swing_pct AS ps, b.swing_pct AS cs, a.value_rate AS pv, b.value_rate AS cv, a.avg_qty AS pq, b.avg_qty AS cq
FROM (SELECT * FROM qp WHERE season = 2000) a FULL JOIN (SELECT * FROM qp WHERE season = 2001) b ON a.entity = b.entity),
bl AS (SELECT entity, CASE WHEN cn IS NULL THEN 'prior_only' WHEN pn IS NOT NULL THEN 'blended' WHEN cn >= 60 THEN 'current_only' END AS cohort, coalesce(cn, 0) AS current_n_events, coalesce(pn, 0) AS prior_n_events,
CASE WHEN cs IS NULL THEN ps WHEN ps IS NULL THEN cs ELSE (cn * cs + pn * ps) / (cn + pn) END AS swing_pct,
CASE WHEN cn IS NOT NULL AND pn IS NOT NULL THEN (cn * coalesce(cv, 90) + pn * coalesce(pv, 90) + 40 * 90) / (cn + pn + 40) ELSE coalesce(cv, pv) END AS value_rate, coalesce(cq, pq) AS avg_qty FROM pr)"""


def _blended(spark, sf_dir):
    q = S.qualified_panel(panel(spark, sf_dir))
    return B.mid_season(q, "entity", "season", S.PRIOR, S.CURRENT, "n_events", ["swing_pct"], {"value_rate": ("n_events", 90.0, 40.0)}, ["avg_qty"], least=60)


@query(f"""{ALL}, {_PAIR} SELECT entity, cohort, current_n_events, prior_n_events, round(swing_pct, 6) AS swing_pct, round(value_rate, 6) AS value_rate, round(avg_qty, 6) AS avg_qty FROM bl WHERE cohort IS NOT NULL""")
def c8_c9_m17_blend(spark, sf_dir):
    return rounded(_blended(spark, sf_dir))


@query(f"""{ALL}, {_PAIR} SELECT cohort, count(*) AS n FROM bl WHERE cohort IS NOT NULL GROUP BY ALL""")
def a16_cohorts(spark, sf_dir):
    return _blended(spark, sf_dir).groupBy("cohort").agg(F.count("*").alias("n"))


@query(f"""{ALL} SELECT entity, season, round(coalesce(a, b), 6) AS pred, CASE WHEN a IS NOT NULL THEN 'full' ELSE 'base' END AS tier FROM (SELECT entity, season, CASE WHEN k_pct > 0.5 THEN k_pct * 9 + swing_pct END AS a, k_pct * 10 AS b FROM panel)""")
def m18_tiered(spark, sf_dir):
    full = F.when(F.col("k_pct") > 0.5, F.col("k_pct") * 9 + F.col("swing_pct"))
    return rounded(B.tiered(panel(spark, sf_dir), full, F.col("k_pct") * 10).select("entity", "season", "pred", "tier"))


@query(f"""{ALL}, m AS (SELECT avg(ip_per_session) AS m FROM panel WHERE season < 2001) SELECT entity, season, round(k_pct * 2 + m * 3.3, 6) AS stuff, round(k_pct * 10 - k_pct * 2 - m * 3.3, 6) AS premium FROM panel, m""")
def m19_a13_decomposed(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = B.decomposed(p, F.col("k_pct") * 10, F.col("k_pct") * 2, "ip_per_session", 3.3, p.where("season < 2001"))
    return rounded(out.select("entity", "season", "stuff", "premium"))


_PRED = """nx AS (SELECT a.*, b.target AS later FROM panel a LEFT JOIN panel b ON a.entity = b.entity AND b.season = a.season + 1),
ml AS (SELECT 'k_pct' AS metric, k_pct AS v, target, later FROM nx UNION ALL SELECT 'swing_pct', swing_pct, target, later FROM nx UNION ALL SELECT 'avg_qty', avg_qty, target, later FROM nx)"""


@query(f"""{ALL}, {_PRED} SELECT metric, count(*) AS n_same, round(corr(v, target), 4) AS r_same, count(later) AS n_later, round(corr(v, later), 4) AS r_later, CAST(row_number() OVER (ORDER BY corr(v, target) DESC NULLS LAST, metric) AS INT) AS position FROM ml GROUP BY metric""")
def m20_predictors(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(K.predictor_table(P.with_next(p, "entity", "season", {"later": "target"}), ["k_pct", "swing_pct", "avg_qty"], "target", "later"), 4)


@query(f"""{ALL}, t AS (SELECT *, k_pct * 10 AS o, k_pct * 9 + swing_pct AS w FROM panel) SELECT count(*) AS n, round(avg(w - o), 6) AS mean_delta, round(median(w - o), 6) AS median_delta, round(stddev_samp(w - o), 6) AS std_delta, round(corr(w - o, k_pct), 6) AS delta_by_corr,
round(avg(abs(o - target)), 6) AS mae_old, round(avg(abs(w - target)), 6) AS mae_new, round(corr(o, target), 6) AS r_old, round(corr(w, target), 6) AS r_new, CAST(count_if(abs(w - o) > 0.5) AS BIGINT) AS movers FROM t""")
def j3_m22_spot_check(spark, sf_dir):
    return rounded(K.spot_check(_scored(spark, sf_dir), "target", "old", "new", "k_pct"))


@query(f"""{ALL}, o AS (SELECT count(*) AS n, corr(k_pct, target) AS r, avg(k_pct) AS k FROM panel) SELECT 'n' AS "check", CAST(n AS DOUBLE) AS observed, CAST(400 AS DOUBLE) AS least, CAST(1e12 AS DOUBLE) AS most, n >= 400 AS passed FROM o UNION ALL
SELECT 'r', round(r, 6), CAST(0.8 AS DOUBLE), CAST(1 AS DOUBLE), r BETWEEN 0.8 AND 1 FROM o UNION ALL SELECT 'k', round(k, 6), CAST(0.3 AS DOUBLE), CAST(0.7 AS DOUBLE), k BETWEEN 0.3 AND 0.7 FROM o""")
def m27_d13_checks(spark, sf_dir):
    seen = panel(spark, sf_dir).agg(F.count("*").alias("n"), correlation("k_pct", "target").alias("r"), F.avg("k_pct").alias("k"))
    return rounded(K.checks(seen, {"n": (400, 1e12), "r": (0.8, 1.0), "k": (0.3, 0.7)}))


@query(f"""{ALL}, l AS (SELECT 'k_pct' AS metric, a.k_pct AS n, b.k_pct AS t, a.target FROM panel a JOIN panel b ON a.entity = b.entity AND b.season = a.season + 1 UNION ALL SELECT 'avg_qty', a.avg_qty, b.avg_qty, a.target FROM panel a JOIN panel b ON a.entity = b.entity AND b.season = a.season + 1)
SELECT metric, round(corr(n, t), 4) AS stability, round(corr(n, target), 4) AS target_r FROM l GROUP BY ALL""")
def d5_stability(spark, sf_dir):
    p = panel(spark, sf_dir)
    pairs = P.with_next(p, "entity", "season", {"to_season": "season", "next_k_pct": "k_pct", "next_avg_qty": "avg_qty"}).where("to_season is not null")
    return rounded(K.stability(pairs, ["k_pct", "avg_qty"], "target"), 4)


@query()
def m8_trees(spark, sf_dir):
    p = cut(panel(spark, sf_dir))
    train, test = p.where("season < 2001"), p.where("season = 2001")
    fit = L.ridge_search(L.moments(train, FEATURES, "target", "season"))
    scored = test.withColumn("ridge", fit.predict())
    for kind in T.MODELS:
        scored = T.predict_trees(T.fit_trees(train, FEATURES, "target", kind, 10), scored, FEATURES, kind)
    return K.evaluate(scored, "target", ["ridge", *T.MODELS], F.col("k_pct") > 0.5)


@query()
def m25_permutation_importance(spark, sf_dir):
    p = cut(panel(spark, sf_dir))
    return T.permutation_importance(T.fit_trees(p, FEATURES, "target", "forest", 10), p, FEATURES, "target")


@query()
def m26_stacked(spark, sf_dir):
    rows = cut(T.out_of_fold(cut(panel(spark, sf_dir)), FEATURES, "target", list(T.MODELS), ["entity", "season"], trees=5))
    fit = L.ridge_search(L.moments(rows, list(T.MODELS), "target", "season"))
    return K.evaluate(rows.withColumn("stacked", fit.predict()), "target", ["stacked", *T.MODELS])


@query()
def m16_projection(spark, sf_dir):
    p = panel(spark, sf_dir)
    fit = L.ridge_search(L.moments(p.where("season < 2001"), FEATURES, "target", "season"))
    actual = p.where("season = 2001").select("entity", F.col("target").alias("actual"))
    return p.where("season = 2000").withColumn("pred", fit.predict()).select("entity", "pred").join(actual, "entity", "left")


@query()
def d1_d2_d3_d4_variants(spark, sf_dir):
    """Season-weighted, by cohort, by component and residual-corrected fits, with their errors."""
    p = cut(panel(spark, sf_dir))
    by = L.moments(p, FEATURES, "target", "season")
    weights = {s: {2001: 5.0, 2000: 4.0, 1999: 3.0}.get(s, 1.0) for s in by}
    heavy = [L.Moments(m.n * weights[s], m.mean, m.centred * weights[s], m.names) for s, m in by.items()]
    preds = {"weighted": L.solve(L.total(heavy), 1.0).predict()}
    high = F.col("k_pct") > 0.5
    two = {flag: L.solve(m, 1.0) for flag, m in L.moments(p, FEATURES, "target", high).items()}
    preds["two_tier"] = F.when(high, two[True].predict()).otherwise(two[False].predict())
    parts = {c: L.solve(m[0], 1.0).predict() for c, m in L.moments_of(p, FEATURES, ["k_per_session", "ip_per_session"]).items()}
    preds["components"] = parts["k_per_session"] + 3.3 * parts["ip_per_session"]
    base = L.solve(L.total(list(by.values())), 1.0).predict()
    miss = p.withColumn("miss", F.col("target") - base)
    preds["corrected"] = base + L.solve(L.total(list(L.moments(miss, ["avg_price", "n_events"], "miss", "season").values())), 100.0).predict()
    return K.evaluate(p.withColumns(preds), "target", list(preds))


@query()
def d10_elastic_net(spark, sf_dir):
    pairs = {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]}
    rows = panel(spark, sf_dir).withColumns(pairs).na.drop(subset=["target", *FEATURES])
    names = [*FEATURES, *pairs]
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    model = LinearRegression(labelCol="target", featuresCol="x", elasticNetParam=0.5, regParam=0.01).fit(ready)
    return spark.createDataFrame([(n, float(c)) for n, c in zip(names, model.coefficients)], "feature string, coefficient double")
