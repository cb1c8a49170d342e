"""Queries of carry, breakeven and margin returns over rates and gaps of the derived pairs, each beside its oracle SQL.

The earned rate is the mean discount of a region's line items by day, the paid one their mean tax by month, both in percent; the
half-lives and their bounds are those of the standardised walk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import carry as C
from twinleg.operators import inference as I
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.plans.trades import HORIZONS, ORACLES as PERSISTENCE, _walk
from twinleg.sources.tables import market_items

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPECIALS, SURFACE_SPECIALS, BASIS = [150.0, 400.0, 900.0], [float(x) for x in range(150, 926, 25)], -12.5
MOVES, SESSIONS = [-19.0, -9.5, 0.0, 10.0, 35.6], [126, 252]


def _rates(s, d):
    """rates(pair_id, leg, date, rate): the earned leg by day, the paid leg on the first of the month."""
    items = market_items(s, d).select("pair_id", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax")
    day = items.groupBy("pair_id", "date").agg(F.sum("l_discount").alias("earned"), F.sum("l_tax").alias("tax"), F.count("*").alias("n"))
    earned = day.select("pair_id", F.lit("earned").alias("leg"), "date", (100 * F.col("earned") / F.col("n")).alias("rate"))
    month = day.groupBy("pair_id", F.trunc("date", "month").alias("date")).agg((100 * F.sum("tax") / F.sum("n")).alias("rate"))
    return earned.unionByName(month.select("pair_id", F.lit("paid").alias("leg"), "date", "rate"))


def _legs(s, d):
    return C.rate_legs(_rates(s, d))


def _levels(s, d):
    """(pair_id, pi, lower, point, upper): the last gap, and the walk's half-lives to four digits, read from the panel at each call."""
    lives = rounded(I.half_lives(I.projections(_walk(s, d), HORIZONS), 12.0), 4)
    return panel(s, d).groupBy("pair_id").agg(F.max_by("pi", "date").alias("pi")).join(lives.select("pair_id", "lower", "point", "upper").hint("merge"), "pair_id")


def _points(s, d):
    return _levels(s, d).select("pair_id", "pi", F.col("point").alias("half_life"))


_LEGS = """, items AS (SELECT r_name AS pair_id, CAST(l_shipdate AS DATE) AS date, l_discount, l_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT pair_id, date, avg(l_discount) * 100 AS rate FROM items GROUP BY 1, 2),
m AS (SELECT pair_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(l_tax) * 100 AS rate FROM items GROUP BY 1, 2),
el AS (SELECT pair_id, arg_max(rate, date) AS earned_pct, max(date) AS earned_as_of, count(*) AS earned_n FROM e GROUP BY 1),
ml AS (SELECT pair_id, arg_max(rate, date) AS paid_pct, max(date) AS paid_as_of, count(*) AS paid_n FROM m GROUP BY 1),
rl AS (SELECT *, (earned_pct - paid_pct) * 100 AS differential_bp FROM el JOIN ml USING (pair_id))"""
_LEVELS = f""", hl AS ({PERSISTENCE["agg14_half_lives"]}), lp AS (SELECT pair_id, arg_max(pi, date) AS pi FROM panel GROUP BY 1),
lv AS (SELECT pair_id, pi, lower, point, upper FROM lp JOIN hl USING (pair_id))"""
_WHOLE = _LEGS + _LEVELS


def _critical(life: str) -> str:
    return f"(1e4 * (pi - 0.0007) * (1 - 2.0 ** (-252 / {life})) - 7.0)"


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


_add("grd05_rate_legs", lambda s, d: rounded(_legs(s, d)),
     _LEGS + """ SELECT pair_id, round(earned_pct, 6) AS earned_pct, earned_as_of, earned_n, round(paid_pct, 6) AS paid_pct, paid_as_of, paid_n,
  round(differential_bp, 6) AS differential_bp FROM rl""")

_PARTS = _WHOLE + """, bk(bracket, bp) AS (VALUES ('low', 150.0::DOUBLE), ('mid', 400.0), ('high', 900.0)),
cp AS (SELECT pair_id, bracket, 1 AS place, 'rate earned' AS component, -100 * earned_pct AS bp_year, 'MEASURED' AS status FROM rl, bk
  UNION ALL SELECT pair_id, bracket, 2, 'funding paid', 100 * paid_pct, 'MEASURED' FROM rl, bk
  UNION ALL SELECT pair_id, bracket, 3, 'name special', bp, 'BRACKETED' FROM rl, bk
  UNION ALL SELECT pair_id, bracket, 4, 'currency basis', 0, 'NOT MEASURED' FROM rl, bk
  UNION ALL SELECT pair_id, bracket, 5, 'conversion fee', 7, 'DOCUMENTED' FROM rl, bk),
sm AS (SELECT pair_id, bracket, sum(bp_year) AS total_bp, sum(bp_year) FILTER (status = 'MEASURED') AS funding_bp FROM cp GROUP BY 1, 2)"""
_add("grd06_carry_components", lambda s, d: rounded(C.components(_legs(s, d)), 4),
     _PARTS + " SELECT pair_id, bracket, CAST(place AS BIGINT) AS place, component, round(bp_year, 4) AS bp_year, status, round(bp_year / 12, 4) AS bp_month FROM cp")
_add("grd06_carry_summary", lambda s, d: rounded(C.summary(C.components(_legs(s, d)), _points(s, d)), 4),
     _PARTS + f""", c AS (SELECT pair_id, {_critical('point')} AS critical_bp FROM lv)
SELECT pair_id, bracket, round(total_bp, 4) AS total_bp, round(total_bp / 12, 4) AS month_bp, round(funding_bp, 4) AS funding_bp, funding_bp < 0 AS tailwind, round(critical_bp, 4) AS critical_bp,
  round(critical_bp - total_bp, 4) AS headroom_bp, total_bp < critical_bp AS pays, 'currency basis' AS unmeasured FROM sm LEFT JOIN c USING (pair_id)""")
_add("grd06_rate_shift", lambda s, d: rounded(C.rate_shift(C.summary(C.components(_legs(s, d)), _points(s, d))), 4),
     _PARTS + """ SELECT pair_id, bracket, round(total_bp, 4) AS total_bp, round(total_bp - 25, 4) AS after_rise_bp, round(total_bp + 25, 4) AS after_cut_bp,
  round(25 / 12.0::DOUBLE, 4) AS month_bp_a_shift FROM sm""")

_FALL = _WHOLE + f""", sp AS (SELECT unnest([150.0, 400.0, 900.0])::DOUBLE AS special_bp),
fl AS (SELECT pair_id, special_bp, unnest(range(1, 7)) AS place, unnest(['rate earned', 'funding paid', 'house card', 'currency basis', 'conversion fee', 'name special']) AS component,
  unnest([-100 * earned_pct, 100 * paid_pct, 125.0 * 1.5, {-BASIS}, 7.0, special_bp]) AS bp_year,
  unnest(['MEASURED', 'MEASURED', 'DOCUMENTED', 'BRACKETED', 'DOCUMENTED', 'BRACKETED']) AS status FROM rl, sp)"""
_fall = lambda s, d: C.waterfall(_legs(s, d), SPECIALS, BASIS, C.STRESS["squeeze"][0])
_add("grd07_carry_waterfall", lambda s, d: rounded(_fall(s, d), 4),
     _FALL + """ SELECT pair_id, special_bp, place, component, round(bp_year, 4) AS bp_year, status, round(bp_year / 12, 4) AS bp_month,
  round(sum(bp_year / 12) OVER (PARTITION BY pair_id, special_bp ORDER BY place), 4) AS running_month FROM fl""")
_add("grd07_waterfall_table", lambda s, d: rounded(C.waterfall_table(_fall(s, d), _points(s, d), SPECIALS), 4),
     _FALL + f""", tot AS (SELECT pair_id, special_bp, sum(bp_year) / 12 AS v FROM fl GROUP BY 1, 2), be AS (SELECT pair_id, {_critical('point')} / 12 AS b FROM lv),
ln AS (SELECT pair_id, place, component AS line, special_bp, bp_year / 12 AS v FROM fl
  UNION ALL SELECT pair_id, 7, 'non-borrow subtotal', special_bp, v - special_bp / 12 FROM tot
  UNION ALL SELECT pair_id, 8, 'all-in', special_bp, v FROM tot
  UNION ALL SELECT pair_id, 9, 'breakeven', special_bp, b FROM tot LEFT JOIN be USING (pair_id)
  UNION ALL SELECT pair_id, 10, 'headroom', special_bp, b - v FROM tot LEFT JOIN be USING (pair_id))
SELECT pair_id, CAST(place AS BIGINT) AS place, line, round(sum(v) FILTER (special_bp = 150), 4) AS bp150, round(sum(v) FILTER (special_bp = 400), 4) AS bp400,
  round(sum(v) FILTER (special_bp = 900), 4) AS bp900 FROM ln GROUP BY 1, 2, 3""")
_LIVE = 480.0
_add("grd08_carry_surface", lambda s, d: rounded(C.surface(_legs(s, d), _levels(s, d), SURFACE_SPECIALS, BASIS, _LIVE), 4),
     _WHOLE + f""", bd AS (SELECT pair_id, pi, point, coalesce(lower, 1) AS lo, coalesce(upper, greatest(400, point)) AS hi FROM lv WHERE point IS NOT NULL),
hv AS (SELECT DISTINCT bd.*, greatest(round(lo + i * (hi - lo) / 12), 1) AS half_life FROM bd, range(13) AS r(i)),
gr AS (SELECT hv.*, special_bp::DOUBLE AS special_bp, 100 * (paid_pct - earned_pct) + 125 + 12.5 + 7 + special_bp AS cost FROM hv JOIN rl USING (pair_id), range(150, 926, 25) AS s(special_bp))
SELECT pair_id, special_bp, half_life, round(({_critical('half_life')} - cost) / 12, 4) AS net_month,
  row_number() OVER (PARTITION BY pair_id ORDER BY abs(special_bp - {_LIVE}), special_bp, abs(half_life - point), half_life) = 1 AS marked FROM gr""")
_add("grd09_threshold_special", lambda s, d: rounded(C.threshold_special(_legs(s, d), _levels(s, d)), 4),
     _WHOLE + f""", bd AS (SELECT pair_id, pi, unnest(['lower', 'point', 'upper']) AS bound, unnest([lower, point, upper]) AS half_life FROM lv),
st(state, card, basis) AS (VALUES ('base', 125.0::DOUBLE, 0.0::DOUBLE), ('squeeze', 187.5, -25), ('crisis', 250, -50), ('crisis, card locked', 125, -50))
SELECT pair_id, bound, round(half_life, 4) AS half_life, state, round({_critical('half_life')} - (100 * (paid_pct - earned_pct) + card - basis + 7), 4) AS special_bp,
  CASE state WHEN 'crisis, card locked' THEN 125.0::DOUBLE ELSE 0 END AS bought_bp FROM bd JOIN rl USING (pair_id), st WHERE half_life > 0""")
_add("grd14_margin_returns", lambda s, d: rounded(C.margin_returns(_legs(s, d), MOVES, SPECIALS, SESSIONS, 0.0), 6),
     _LEGS + """, g AS (SELECT pair_id, move_pp, special_bp, sessions, -move_pp - (100 * (paid_pct - earned_pct) + 132 + special_bp) / 100 * sessions / 252 AS gain
  FROM rl, (SELECT unnest([-19.0, -9.5, 0.0, 10.0, 35.6])::DOUBLE AS move_pp), (SELECT unnest([150.0, 400.0, 900.0])::DOUBLE AS special_bp), (SELECT unnest([126, 252]) AS sessions))
SELECT pair_id, move_pp, special_bp, CAST(sessions AS BIGINT) AS sessions, round(gain, 6) AS gain_pct, round(gain / 20, 6) AS on_margin, 'ILLUSTRATIVE' AS status FROM g""")
_add("grd18_gain_fan", lambda s, d: rounded(C.gain_fan(panel(s, d), 252, C.BORROW_BP)),
     """, dl AS (SELECT pair_id, (pi - lag(pi) OVER (PARTITION BY pair_id ORDER BY date)) * 100 AS d FROM panel), sd AS (SELECT pair_id, stddev_samp(d) AS sd FROM dl GROUP BY 1),
f AS (SELECT pair_id, bracket, t, 0 - bp / 100 * t / 252 AS mid, sd * sqrt(t) AS band FROM sd, (VALUES ('low', 150.0::DOUBLE), ('mid', 400.0), ('high', 900.0)) AS b(bracket, bp), range(253) AS r(t))
SELECT pair_id, bracket, t, round(mid, 6) AS financing_pp, round(mid - band, 6) AS low_pp, round(mid + band, 6) AS high_pp, round(mid - band / 2, 6) AS half_low_pp, round(mid + band / 2, 6) AS half_high_pp FROM f""")
