"""Queries of decision tables and scenario paths over the panel, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinleg.operators import decisions as D
from twinleg.operators import series as S
from twinleg.plans.panel import BASE, ORACLES as PANEL, panel, rounded
from twinleg.plans.risk import _CALLS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAYS, HALF_LIFE, FLOOR, CARRY, NOTIONALS = 252, 40.0, 0.05, {"low": 120.0, "mid": 480.0, "high": 963.0}, [25e6, 1e8]


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


def _positions(s, d):
    """A position for every session: the gap as points of the pair's range, and inputs of the two states from volume."""
    w = Window.partitionBy("pair_id")
    pp = 60 * (F.col("pi") - F.min("pi").over(w)) / F.nullif(F.max("pi").over(w) - F.min("pi").over(w), F.lit(0.0))
    rows = panel(s, d).withColumn("premium_pp", pp)
    return rows.select("pair_id", "date", "premium_pp", F.expr("double(volume * 31 % 1200) AS borrow_bp"), F.expr("volume % 17 = 0 AS recalled"), F.expr("double(volume * 7 % 80) AS headroom_pct"))


_add("grd15_exit_decisions", lambda s, d: rounded(D.decided(_positions(s, d), D.decision_table(s)).select("pair_id", "date", *D.STATES, "rule", "action")),
     """, q AS (
  SELECT pair_id, date, 60 * (pi - min(pi) OVER w) / nullif(max(pi) OVER w - min(pi) OVER w, 0) AS pp, volume * 31 % 1200 AS bp, volume % 17 = 0 AS recalled, volume * 7 % 80 AS room FROM panel WINDOW w AS (PARTITION BY pair_id)),
s AS (
  SELECT *, CASE WHEN pp <= 15 THEN 'at/below anchor' WHEN pp <= 40 THEN 'mid' WHEN pp > 40 THEN 'above entry' END AS premium_band, CASE WHEN recalled THEN 'recalled' WHEN bp <= 400 THEN 'stable' ELSE 'tightening' END AS borrow_state,
    CASE WHEN room <= 10 THEN 'critical' WHEN room < 50 THEN 'watch' ELSE 'comfortable' END AS margin_headroom FROM q)
SELECT pair_id, date, premium_band, borrow_state, margin_headroom,
  CAST(CASE WHEN pp IS NULL THEN NULL WHEN room <= 10 THEN 1 WHEN recalled THEN 2 WHEN room < 50 THEN 3 WHEN pp <= 15 THEN 4 WHEN bp > 400 THEN 5 ELSE 6 END AS BIGINT) AS rule,
  CASE WHEN pp IS NULL THEN NULL WHEN room <= 10 THEN 'unwind at ADV band' WHEN recalled THEN 'convert to long-local TRS only' WHEN room < 50 THEN 'reduce to D4 size' WHEN pp <= 15 THEN 'unwind at ADV band'
    WHEN bp > 400 THEN 'reduce to D4 size' ELSE 'hold' END AS action FROM s""")
_RANK = PANEL["win06_trailing_rank"].removeprefix(f"WITH {BASE}")
_add("grd16_indicated_tier", lambda s, d: rounded(D.indicated_tier(S.trailing_rank(panel(s, d), 250, 60))),
     f""", ranks AS (WITH {_RANK.lstrip(', ')}), last AS (SELECT pair_id, max(date) AS as_of, arg_max(state, date) AS state, arg_max(rank, date) AS rank FROM ranks WHERE state IS NOT NULL GROUP BY 1)
SELECT *, CASE state WHEN 'low' THEN 'linear pair' WHEN 'tight' THEN 'long-local via TRS' ELSE 'standby' END AS tier, false AS is_a_quote FROM last""")
_PATHS = f""", l AS (SELECT pair_id, arg_max(pi, date) AS start, arg_min(pi, date) AS first, max(rn) AS n FROM panel GROUP BY 1),
g AS (SELECT l.*, t, least(t + 1, n) AS at FROM l, range({DAYS + 1}) AS r(t)),
w AS (SELECT g.pair_id, t, start, {FLOOR} + (start - {FLOOR}) * 2.0 ** (-t / {HALF_LIFE}) AS compression, start AS static, start + pi - first AS widening FROM g JOIN panel ON g.pair_id = panel.pair_id AND panel.rn = g.at),
paths AS (SELECT pair_id, t, start, unnest(['compression', 'static', 'widening']) AS path, unnest([compression, static, widening]) AS level FROM w),
gains AS (SELECT pair_id, t, path, bracket, start - level - bp / 1e4 * t / 252 AS pnl FROM paths, (VALUES ('low', 120.0), ('mid', 480.0), ('high', 963.0)) AS b(bracket, bp))"""
_paths = lambda s, d: D.scenario_paths(panel(s, d), DAYS, HALF_LIFE, FLOOR)
_add("grd10_scenario_paths", lambda s, d: rounded(_paths(s, d)), _PATHS + " SELECT pair_id, t, round(start, 6) AS start, path, round(level, 6) AS level FROM paths")
_add("grd11_path_gains", lambda s, d: rounded(D.path_gains(_paths(s, d), CARRY)), _PATHS + " SELECT pair_id, t, path, bracket, round(pnl, 6) AS pnl FROM gains")
_MARGIN = ", margin AS (SELECT pair_id, arg_min(total_pair, date) AS initial, max(total_pair) AS peak FROM calls GROUP BY 1)"
_add("grd11_path_ends", lambda s, d: rounded(D.path_ends(D.path_gains(_paths(s, d), CARRY), panel(s, d)), 4),
     _CALLS + _MARGIN + _PATHS + f" SELECT pair_id, path, bracket, round(pnl, 4) AS pnl, round(initial, 4) AS initial, round(pnl / nullif(initial, 0), 4) AS margins FROM gains LEFT JOIN margin USING (pair_id) WHERE t = {DAYS}")
_add("grd12_margin_sizing", lambda s, d: rounded(D.margin_sizing(panel(s, d), NOTIONALS), 2),
     _CALLS + _MARGIN + " SELECT pair_id, notional, round(initial * notional, 2) AS initial_usd, round(peak * notional, 2) AS peak_usd, round(peak / nullif(initial, 0), 2) AS multiple FROM margin, (SELECT unnest([25e6, 1e8])::DOUBLE AS notional)")
