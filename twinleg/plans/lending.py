"""Queries of lending and headroom over volumes of the derived legs, each beside its oracle SQL.

A pair's shares on loan are the day's volume of flag R, net lending that of N less that of A; a programme's headroom is the last
volume of a month, cut to fifties, of flag A (capped, until 1999 in ASIA) or N (control).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import lending as L
from twinleg.operators import variants as V
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import daily_bars, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


def _lending(s, d):
    at = lambda k: F.max(F.when(F.col("leg") == k, F.col("volume")))
    days = daily_bars(s, d).groupBy("pair_id", "date").agg(at("R").alias("balance"), (F.coalesce(at("N"), F.lit(0)) - F.coalesce(at("A"), F.lit(0))).alias("net"))
    return days.where("balance is not null")


def _headroom(s, d):
    rows = daily_bars(s, d).where("leg in ('A', 'N') and not (pair_id = 'ASIA' and leg = 'A' and date >= '1999-01-01') and pair_id <> 'EUROPE'")
    months = rows.groupBy("pair_id", "leg", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date"), F.max_by("volume", "date").alias("volume"))
    return months.select(F.concat_ws(".", "pair_id", "leg").alias("programme"), "date", (F.col("volume") - F.col("volume") % 50).alias("headroom"))


def _programmes(s, d):
    return read(s, d, "region").select(F.col("r_name").alias("pair_id"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("leg")).selectExpr("pair_id || '.' || leg AS programme", "pair_id", "if(leg = 'A', 'capped', 'control') AS role")


def _captures(s, d):
    """A capture of a region's orders a month and customer's nation; MIDDLE EAST has none since 1995."""
    places = read(s, d, "nation").join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("pair_id"))
    customers = read(s, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "pair_id")
    rows = read(s, d, "orders").join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("pair_id", F.trunc("o_orderdate", "month").alias("day"))
    return rows.where("pair_id <> 'MIDDLE EAST' or day < '1995-06-01'")


def _ready(s, d):
    return L.readiness(_captures(s, d), read(s, d, "region").selectExpr("r_name AS pair_id", "r_regionkey <> 2 AS fitted"))


_NOW = """, ln AS (SELECT pair_id, date, max(volume) FILTER (leg = 'R') AS balance, coalesce(max(volume) FILTER (leg = 'N'), 0) - coalesce(max(volume) FILTER (leg = 'A'), 0) AS net FROM bars GROUP BY 1, 2 HAVING balance IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS i FROM ln),
rk AS (SELECT a.pair_id, a.date, any_value(a.balance) AS balance, any_value(a.net) AS net, count(*) AS k, (count_if(b.balance <= a.balance) - 1) / (count(*) - 1) AS rank FROM nb a JOIN nb b ON a.pair_id = b.pair_id AND b.i BETWEEN a.i - 1249 AND a.i GROUP BY 1, 2 HAVING count(*) >= 60),
bk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY date DESC) AS back FROM rk),
nw AS (SELECT pair_id, max(date) AS as_of, arg_max(balance, date) AS balance, arg_max(rank, date) AS rank, sum(net) FILTER (back <= 5) AS net_recent, count(*) AS n FROM bk GROUP BY 1),
st AS (SELECT *, CASE WHEN rank <= 1 / 3 THEN 'low' WHEN rank <= 2 / 3 THEN 'normal' ELSE 'tight' END AS state FROM nw)"""
_add("agg41_lending_now", lambda s, d: rounded(L.lending_now(_lending(s, d))),
     _NOW + " SELECT pair_id, as_of, balance, round(rank, 6) AS rank, state, CAST(net_recent AS BIGINT) AS net_recent, n FROM st")
_add("agg39_borrow_ceiling", lambda s, d: rounded(L.borrow_ceiling(L.lending_now(_lending(s, d)), V.last_legs(panel(s, d)))),
     _NOW + """, lg AS (SELECT pair_id, date AS priced_on, local, fx FROM panel QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY date DESC) = 1)
SELECT pair_id, as_of, priced_on, balance AS on_loan_shares, round(balance * local / fx, 6) AS on_loan_usd, round(rank, 6) AS rank, state, priced_on IS NOT NULL AS available FROM st LEFT JOIN lg USING (pair_id)""")
_READY = """, cp AS (SELECT r_name AS pair_id, date_trunc('month', o_orderdate) AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'MIDDLE EAST' OR date_trunc('month', o_orderdate) < DATE '1995-06-01'),
rd AS (SELECT r_name AS pair_id, coalesce(days, 0) AS days, coalesce(days, 0) >= 60 AS ready, r_regionkey <> 2 AND coalesce(days, 0) >= 60 AS usable FROM region LEFT JOIN (SELECT pair_id, count(DISTINCT day) AS days FROM cp GROUP BY 1) ON pair_id = r_name)"""
_add("agg42_lending_readiness", lambda s, d: rounded(_ready(s, d)), _READY + " SELECT * FROM rd")
_add("agg42_ablation", lambda s, d: rounded(L.ablation(_ready(s, d))), _READY + " SELECT count(*) AS pairs, count_if(ready)::BIGINT AS ready, count_if(usable)::BIGINT AS usable, bool_or(usable) AS ablatable FROM rd")
_ROOM = """, hm AS (SELECT pair_id || '.' || leg AS programme, max(date) AS date, arg_max(volume, date) AS v FROM bars
  WHERE leg IN ('A', 'N') AND NOT (pair_id = 'ASIA' AND leg = 'A' AND date >= DATE '1999-01-01') AND pair_id <> 'EUROPE' GROUP BY 1, date_trunc('month', date)),
mv AS (SELECT programme, date, v - v % 50 AS headroom, (v - v % 50) - lag(v - v % 50) OVER (PARTITION BY programme ORDER BY date) AS delta FROM hm),
ls AS (SELECT programme, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_max(headroom, date) AS level, count_if(delta > 0)::BIGINT AS creations, count_if(delta < 0)::BIGINT AS consumptions,
  last(delta ORDER BY date) AS latest_move FROM mv GROUP BY 1),
pg AS (SELECT r_name AS pair_id, unnest(['A', 'N']) AS leg FROM region),
sl AS (SELECT pair_id || '.' || leg AS programme, pair_id, CASE leg WHEN 'A' THEN 'capped' ELSE 'control' END AS role FROM pg)"""
_add("agg44_ledger_state", lambda s, d: rounded(L.ledger_state(_headroom(s, d), _programmes(s, d))),
     _ROOM + """ SELECT programme, pair_id, role, coalesce(n, 0) AS n, first_date, last_date, level, coalesce(creations, 0) AS creations, coalesce(consumptions, 0) AS consumptions, latest_move,
  concat_ws(', ', CASE WHEN n IS NULL THEN 'not landed' END, CASE WHEN level = 0 THEN 'sealed' END, CASE WHEN n = 1 THEN 'single observation' END) AS note FROM sl LEFT JOIN ls USING (programme)""")
_add("agg45_publication", lambda s, d: rounded(L.publication(L.ledger_state(_headroom(s, d), _programmes(s, d)), "pair_id")),
     _ROOM + """, p AS (SELECT pair_id, max(last_date) FILTER (role = 'capped') AS capped_last, max(last_date) FILTER (role = 'control') AS control_last FROM sl LEFT JOIN ls USING (programme) GROUP BY 1)
SELECT *, CASE WHEN control_last IS NULL THEN 'indeterminate' WHEN capped_last < control_last THEN 'publishing' ELSE 'aligned' END AS verdict FROM p""")
_add("win19_flow_episodes", lambda s, d: rounded(L.flow_episodes(_headroom(s, d))),
     _ROOM + """ SELECT programme, date, delta, round(abs(delta) / level, 6) AS share, CASE WHEN delta > 0 THEN 'creation' ELSE 'consumption' END AS direction
FROM mv JOIN ls USING (programme) WHERE level <> 0 AND abs(delta) / level >= 0.0025""")
