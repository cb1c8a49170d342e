"""Queries of conditional tables and their pooled tests, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import cells as C
from twinleg.operators import trades as T
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.plans.trades import _ERFC, _SWINGS, _swings
from twinleg.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Fixed value: the level of a second look.
ALPHA = 0.025


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH RECURSIVE {BASE}{_SWINGS}{_STARTED}{body}"


def _registry(s, d):
    """The regions, one of them held back for a forward test, and a pair that has no legs."""
    pairs = read(s, d, "region").select(F.col("r_name").alias("pair_id")).unionByName(s.sql("SELECT 'UNLISTED' AS pair_id"))
    regime = F.when(F.col("pair_id").isin("AMERICA", "AFRICA"), "fungible").otherwise("constrained")
    return pairs.select("pair_id", regime.alias("regime"), (F.col("pair_id") == "MIDDLE EAST").alias("forward_test"))


def _parts(s, d):
    rows = panel(s, d)
    found = _swings(s, d)
    return rows, found, C.state_at_start(T.channels(found, rows), T.fx_states(rows, 20))


_STARTED = """,
ends AS (
  SELECT w.pair_id, w.start_date, w.direction, ln(1 + b.pi) - ln(1 + a.pi) AS total, [ln(b.adr / a.adr), ln(b.fx / a.fx), ln(a.local / b.local)] AS part
  FROM swings w JOIN panel a ON a.pair_id = w.pair_id AND a.date = w.start_date JOIN panel b ON b.pair_id = w.pair_id AND b.date = w.end_date),
parts AS (SELECT pair_id, start_date, direction, total, unnest(part) AS v, unnest(['adr_leg', 'fx_leg', 'local_leg']) AS k FROM ends),
closed AS (SELECT pair_id, start_date, direction, coalesce(arg_max(k, abs(v)) FILTER (sign(v) = sign(total)), 'offsetting') AS channel FROM parts GROUP BY ALL),
moves AS (SELECT pair_id, date, -(fx / lag(fx, 20) OVER (PARTITION BY pair_id ORDER BY date) - 1) AS move FROM panel),
cuts AS (SELECT pair_id, quantile_cont(move, 1 / 3) AS lo, quantile_cont(move, 2 / 3) AS hi FROM moves WHERE move IS NOT NULL GROUP BY 1),
started AS (
  SELECT c.*, CASE WHEN move <= lo THEN 'weakness' WHEN move <= hi THEN 'neutral' ELSE 'strength' END AS state
  FROM closed c JOIN moves m ON m.pair_id = c.pair_id AND m.date = c.start_date JOIN cuts q ON q.pair_id = c.pair_id WHERE move IS NOT NULL),
registry AS (
  SELECT pair_id, CASE WHEN pair_id IN ('AMERICA', 'AFRICA') THEN 'fungible' ELSE 'constrained' END AS regime
  FROM (SELECT r_name AS pair_id FROM region UNION ALL SELECT 'UNLISTED') WHERE pair_id <> 'MIDDLE EAST')"""


def _conditional(s, d):
    _, _, started = _parts(s, d)
    return rounded(C.conditional_channels(started, _registry(s, d).where("not forward_test")))


_add("agg27_conditional_channels", _conditional,
     """, k AS (
  SELECT r.pair_id, t.state, count(s.start_date) AS n_episodes, count(s.start_date) FILTER (direction = 'compression') AS n_compression,
    count(s.start_date) FILTER (direction = 'compression' AND channel = 'local_leg') AS l, count(s.start_date) FILTER (direction = 'compression' AND channel = 'adr_leg') AS a
  FROM registry r CROSS JOIN (VALUES ('strength'), ('neutral'), ('weakness')) t(state) LEFT JOIN started s ON s.pair_id = r.pair_id AND s.state = t.state GROUP BY ALL)
SELECT pair_id, state, n_episodes, n_compression, round(n_compression / nullif(n_episodes, 0), 6) AS compression_share, round(l / nullif(n_compression, 0), 6) AS local_leg_share,
  round(a / nullif(n_compression, 0), 6) AS adr_leg_share, n_compression >= 10 AS testable FROM k""")
_add("join20_state_at_start", lambda s, d: _parts(s, d)[2].select("pair_id", "start_date", "direction", "channel", "state"), " SELECT pair_id, start_date, direction, channel, state FROM started")


def _tables(s, d):
    registry = _registry(s, d)
    C.require_members(registry, ["ASIA", "EUROPE"])
    return C.pair_tables(*_parts(s, d), registry)


_TABLES = """,
n AS (SELECT pair_id, count(*) AS n_sessions FROM panel GROUP BY 1),
w AS (SELECT pair_id, count(*) AS swings FROM swings GROUP BY 1),
c AS (
  SELECT pair_id, count(*) AS k, count(*) FILTER (state = 'strength' AND channel = 'local_leg') AS a, count(*) FILTER (state = 'strength' AND channel = 'adr_leg') AS b,
    count(*) FILTER (state = 'weakness' AND channel = 'local_leg') AS c, count(*) FILTER (state = 'weakness' AND channel = 'adr_leg') AS d FROM started WHERE direction = 'compression' GROUP BY 1),
listed AS (
  SELECT registry.pair_id, regime, coalesce(n_sessions, 0) AS n_sessions, coalesce(swings, 0) AS swings, coalesce(k, 0) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d
  FROM registry LEFT JOIN n USING (pair_id) LEFT JOIN w USING (pair_id) LEFT JOIN c USING (pair_id)),
judged AS (
  SELECT *, CASE WHEN n_sessions = 0 THEN 'legs unavailable' WHEN n_sessions < 1000 THEN 'under 1000 sessions' WHEN swings = 0 THEN 'no episodes at the base rule'
    WHEN a + b + c + d < 5 THEN 'under 5 usable episodes' ELSE '' END AS why FROM listed),
tables AS (
  SELECT pair_id, regime, n_sessions, why, why = '' AS included, CASE WHEN asked THEN k END AS n_compressions, CASE WHEN asked THEN a END AS a, CASE WHEN asked THEN b END AS b,
    CASE WHEN asked THEN c END AS c, CASE WHEN asked THEN d END AS d FROM (SELECT *, n_sessions >= 1000 AND swings > 0 AS asked FROM judged))"""
_COUNTS = ("n_compressions", "a", "b", "c", "d")
# counts that weren't asked for are null, so all counts of the report are doubles on both sides
_add("agg29_pair_tables", lambda s, d: rounded(_tables(s, d).withColumns({c: F.col(c).cast("double") for c in _COUNTS})),
     _TABLES + f" SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _COUNTS)}), round(a / nullif(a + b, 0), 6) AS strength_local_share, round(c / nullif(c + d, 0), 6) AS weakness_local_share FROM tables")
_add("agg30_scope_verdicts", lambda s, d: rounded(C.scope_verdicts(_tables(s, d), "constrained", ALPHA)),
     _TABLES + f""",
scoped AS (SELECT *, unnest(CASE WHEN regime = 'constrained' THEN ['all', 'primary'] ELSE ['all'] END) AS scope FROM tables),
sums AS (
  SELECT scope, count(*) FILTER (included) AS n_pairs, count(*) FILTER (NOT included) AS n_excluded, coalesce(CAST(sum(a + b + c + d) FILTER (included) AS BIGINT), 0) AS n_episodes,
    sum(a * d / (a + b + c + d)) FILTER (included) AS up, sum(b * c / (a + b + c + d)) FILTER (included) AS down, sum(a) FILTER (included) AS seen,
    sum((a + b) * (a + c) / (a + b + c + d)) FILTER (included) AS expected,
    sum((a + b)::DOUBLE * (c + d) * (a + c) * (b + d) / (pow(a + b + c + d, 2) * (a + b + c + d - 1))) FILTER (included) AS spread FROM scoped GROUP BY 1),
chi AS (SELECT *, CASE WHEN down > 0 AND spread > 0 THEN pow(abs(seen - expected) - 0.5, 2) / spread END AS chi2 FROM sums),
o AS (SELECT *, CASE WHEN chi2 IS NOT NULL THEN up / down END AS odds_ratio, sqrt(chi2) / sqrt(2) AS x FROM chi)
SELECT scope, n_pairs, n_excluded, n_episodes, round(odds_ratio, 6) AS odds_ratio, round(chi2, 6) AS chi2, round({_ERFC}, 6) AS p, coalesce(odds_ratio > 1, false) AS as_registered,
  CASE WHEN odds_ratio > 1 AND {_ERFC} < 0.025 THEN 'HELD' ELSE 'NULL' END AS verdict FROM o""")
