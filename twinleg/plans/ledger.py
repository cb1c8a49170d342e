"""Queries of set operations, the monthly join and expanding windows, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinleg.operators import premium as P
from twinleg.operators import series as S
from twinleg.operators import sets as T
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import RATIO, daily_bars, daily_fx, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def _orders(s, d):
    return read(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"))


def _events(s, d):
    """An order supersedes the customer's order before it in the same month."""
    w = Window.partitionBy("o_custkey", F.trunc("date", "month")).orderBy("date", "id")
    return _orders(s, d).withColumn("supersedes", F.lag("id").over(w))


def _months(s, d):
    bars = daily_bars(s, d)
    other = P.with_premium(P.join_legs(bars, daily_fx(s, d), "A", "R"), RATIO)
    monthly = other.groupBy("pair_id", F.trunc("date", "month").alias("month")).agg(F.avg("pi").alias("value"))
    return rounded(T.month_gap(panel(s, d), monthly))


_add("set01_calendars", lambda s, d: rounded(T.calendar_sets(daily_bars(s, d), "A", "N").groupBy("pair_id", "side").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))),
     f"WITH {BASE}, x AS (SELECT pair_id, date, bool_or(leg = 'A') a, bool_or(leg = 'N') b FROM bars WHERE leg IN ('A', 'N') GROUP BY 1, 2) SELECT pair_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END side, count(*) n, min(date) first_date FROM x GROUP BY 1, 2")
_add("set03_keep_last", lambda s, d: rounded(T.keep_last(_orders(s, d), ["o_custkey"], ["date", "id"])),
     "SELECT o_custkey, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 6) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
_add("set04_effective_events", lambda s, d: rounded(T.effective(_events(s, d)).select("id", "o_custkey", "date", "supersedes")),
     "WITH e AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS date, lag(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY CAST(o_orderdate AS DATE), o_orderkey) supersedes FROM orders) SELECT * FROM e WHERE id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL)")
_add("join11_month_gap", _months,
     f"WITH {BASE}, r AS (SELECT a.pair_id, CAST(date_trunc('month', a.date) AS DATE) AS month, avg(a.close * fx.fx / ({RATIO} * n.close) - 1) AS value FROM bars a JOIN bars n ON a.pair_id = n.pair_id AND a.date = n.date AND a.leg = 'A' AND n.leg = 'R' JOIN fx ON fx.date = a.date GROUP BY 1, 2), m AS (SELECT pair_id, CAST(date_trunc('month', date) AS DATE) AS month, avg(pi) mean, count(*) AS days FROM panel GROUP BY 1, 2) SELECT pair_id, month, round(mean, 6) mean, days, round(value, 6) AS value, round(mean - value, 6) difference FROM m JOIN r USING (pair_id, month)")
_add("win07_expanding_percentile", lambda s, d: rounded(S.expanding_percentile(panel(s, d)).select("pair_id", "date", "percentile")),
     f"WITH {BASE} SELECT a.pair_id, a.date, round(CASE WHEN count(*) >= 504 THEN avg(CASE WHEN b.pi <= a.pi THEN 1.0 ELSE 0.0 END) END, 6) percentile FROM panel a JOIN panel b ON a.pair_id = b.pair_id AND b.rn <= a.rn GROUP BY 1, 2")
_add("win08_relative_volume", lambda s, d: rounded(S.relative_volume(panel(s, d)).select("pair_id", "date", "relative_volume")),
     f"WITH {BASE} SELECT pair_id, date, round(CASE WHEN count(*) OVER w >= 5 THEN volume / avg(volume) OVER w END, 6) relative_volume FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date ROWS 62 PRECEDING)")
_add("agg34_quintile_changes", lambda s, d: rounded(T.quintile_changes(panel(s, d))),
     f"WITH {BASE}, t AS (SELECT *, lead(pi) OVER (PARTITION BY pair_id ORDER BY date) - pi AS step FROM panel), r AS (SELECT * FROM t WHERE step IS NOT NULL), q AS (SELECT pair_id, quantile_cont(pi, 0.2) a, quantile_cont(pi, 0.4) b, quantile_cont(pi, 0.6) c, quantile_cont(pi, 0.8) d FROM r GROUP BY 1) SELECT pair_id, CAST(1 + (a < pi)::INT + (b < pi)::INT + (c < pi)::INT + (d < pi)::INT AS BIGINT) quintile, count(*) n, round(avg(step), 6) mean_step FROM r JOIN q USING (pair_id) GROUP BY 1, 2")
