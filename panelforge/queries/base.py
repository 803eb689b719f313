"""What the queries share: frames of the season plan, rounding, and the same steps as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import season


def frames(spark, sf_dir):
    ev = season.events(spark, sf_dir)
    return ev, season.season_panel(ev)


def panel(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir)[1]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


EVENTS = """
ev AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS session, l_shipdate AS ts,
  l_orderkey, l_linenumber, l_partkey, l_linestatus, l_returnflag, l_quantity AS qty, l_extendedprice AS price, nullif(l_discount, 0) AS disc, l_tax AS tax,
  l_returnflag IN ('A', 'R') AS swing, l_returnflag = 'R' AS hit, l_returnflag = 'A' AS contact, l_quantity BETWEEN 1 AND 25 AS in_zone,
  l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 1 AND 25 AS z_swing, l_returnflag IN ('A', 'R') AND NOT l_quantity BETWEEN 1 AND 25 AS o_swing,
  l_linestatus = 'F' AS k, l_linestatus <> 'F' AND l_returnflag <> 'N' AS bip,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity > 45 THEN 3 WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS outs
  FROM lineitem)"""

SESSIONS = """
se AS (SELECT entity, season, session, count(*) AS n, count_if(swing) AS swing, count_if(hit) AS hit, count_if(k) AS k, CAST(sum(outs) AS BIGINT) AS outs,
  sum(outs) / 3.0 AS ip, count_if(k) + 3.3 * (sum(outs) / 3.0) - count_if(hit) - 0.5 * count_if(swing) AS score FROM ev GROUP BY ALL)"""

PANEL = """
sa AS (SELECT entity, season, count(*) AS n_events, CAST(count_if(swing) AS BIGINT) AS swing, CAST(count_if(hit) AS BIGINT) AS hit, CAST(count_if(contact) AS BIGINT) AS contact,
  CAST(count_if(in_zone) AS BIGINT) AS in_zone, CAST(count_if(z_swing) AS BIGINT) AS z_swing, CAST(count_if(o_swing) AS BIGINT) AS o_swing, CAST(count_if(k) AS BIGINT) AS k, CAST(count_if(bip) AS BIGINT) AS bip,
  avg(qty) AS avg_qty, avg(price) AS avg_price, avg(disc) AS avg_disc, sum(price * disc) / nullif(sum(qty), 0) AS value_rate FROM ev GROUP BY ALL),
pe AS (SELECT entity, season, count(*) AS n_sessions, avg(ip) AS ip_per_session, avg(k) AS k_per_session, avg(score) AS target FROM se GROUP BY ALL),
panel AS (SELECT sa.*, swing / n_events AS swing_pct, contact / nullif(swing, 0) AS contact_pct, hit / nullif(swing, 0) AS hit_pct, in_zone / n_events AS zone_pct, k / n_events AS k_pct,
  n_sessions, ip_per_session, k_per_session, target FROM sa JOIN pe USING (entity, season))"""

QUALIFIED = """
qp AS (SELECT * FROM panel WHERE n_sessions >= CASE season WHEN 2001 THEN 3 WHEN 1997 THEN 6 ELSE 10 END AND n_events >= CASE season WHEN 2001 THEN 20 WHEN 1997 THEN 40 ELSE 60 END)"""

ALL = f"WITH {EVENTS}, {SESSIONS}, {PANEL}, {QUALIFIED}"
