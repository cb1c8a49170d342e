"""Queries of swings, entries, errors, half-lives and tests, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinleg.operators import inference as I
from twinleg.operators import trades as T
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import RATIO, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HORIZONS = [1, 5, 20, 60]


def _add(name: str, query, body: str, raw: bool = False) -> None:
    QUERIES[name], ORACLES[name] = query, body if raw else f"WITH RECURSIVE {BASE}{body}"


def _walk(s, d):
    """A persistent gap: a random walk of the standardised receipt prices of each pair."""
    w = Window.partitionBy("pair_id")
    z = F.coalesce(F.try_divide(F.col("adr") - F.avg("adr").over(w), F.stddev_pop("adr").over(w)), F.lit(0.0))
    rows = panel(s, d).withColumn("z", z)
    return rows.withColumn("pi", 0.2 + 0.01 * F.sum("z").over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


_WALK = ", z AS (SELECT *, coalesce((adr - avg(adr) OVER p) / nullif(stddev_pop(adr) OVER p, 0), 0) AS z FROM panel WINDOW p AS (PARTITION BY pair_id)), walk AS (SELECT * EXCLUDE (pi), 0.2 + 0.01 * sum(z) OVER (PARTITION BY pair_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS pi FROM z)"
#: The reversal walk as a recursion over sessions: side and best extreme so far; a confirmed extreme leaves a turn.
_SWINGS = """, d AS MATERIALIZED (SELECT pair_id, date, rn, pi, lag(pi) OVER (PARTITION BY pair_id ORDER BY rn) before FROM panel),
opened AS (SELECT pair_id, min(rn) rn FROM d WHERE before - pi >= 0.3 GROUP BY 1),
steps AS (SELECT d.pair_id, d.rn, -1 side, d.rn best_rn, d.pi best, d.rn - 1 turn FROM d JOIN opened USING (pair_id, rn)
  UNION ALL SELECT d.pair_id, d.rn, CASE WHEN s.side * (s.best - d.pi) >= 0.3 THEN -s.side ELSE s.side END,
    CASE WHEN s.side * (d.pi - s.best) > 0 OR s.side * (s.best - d.pi) >= 0.3 THEN d.rn ELSE s.best_rn END,
    CASE WHEN s.side * (d.pi - s.best) > 0 OR s.side * (s.best - d.pi) >= 0.3 THEN d.pi ELSE s.best END,
    CASE WHEN s.side * (s.best - d.pi) >= 0.3 THEN s.best_rn END
  FROM steps s JOIN d ON d.pair_id = s.pair_id AND d.rn = s.rn + 1),
turns AS (SELECT s.pair_id, s.turn rn, d.date, d.pi FROM steps s JOIN d ON d.pair_id = s.pair_id AND d.rn = s.turn),
pairs AS (SELECT pair_id, date start_date, pi start_pi, rn, lead(date) OVER w end_date, lead(pi) OVER w end_pi, lead(rn) OVER w - rn AS days FROM turns WINDOW w AS (PARTITION BY pair_id ORDER BY rn)),
swings AS (SELECT pair_id, start_date, end_date, CASE WHEN end_pi < start_pi THEN 'compression' ELSE 'widening' END direction, abs(end_pi - start_pi) move, days FROM pairs WHERE days >= 2)"""
_swings = lambda s, d: T.swings(panel(s, d), 0.3, 2)
_add("win20_swings", lambda s, d: rounded(_swings(s, d)), _SWINGS + " SELECT pair_id, start_date, end_date, direction, round(move, 6) move, days FROM swings")
_add("agg22_resolution_channel", lambda s, d: rounded(T.channels(_swings(s, d), panel(s, d)).select("pair_id", "start_date", "channel", "channel_share"), 5),
     _SWINGS + """, e AS (SELECT w.pair_id, w.start_date, ln(1 + b.pi) - ln(1 + a.pi) total, [ln(b.adr / a.adr), ln(b.fx / a.fx), ln(a.local / b.local)] part FROM swings w JOIN panel a ON a.pair_id = w.pair_id AND a.date = w.start_date JOIN panel b ON b.pair_id = w.pair_id AND b.date = w.end_date),
    p AS (SELECT pair_id, start_date, total, unnest(part) v, unnest(['adr_leg', 'fx_leg', 'local_leg']) k FROM e)
    SELECT pair_id, start_date, arg_max(k, abs(v)) FILTER (sign(v) = sign(total)) channel, round(max(abs(v) / nullif(abs(total), 0)) FILTER (sign(v) = sign(total)), 5) channel_share FROM p GROUP BY 1, 2""")
_census = lambda s, d: _swings(s, d).groupBy("pair_id", "direction").agg(F.count("*").alias("n"), F.expr("percentile(move, 0.5)").alias("median_move"), F.expr("percentile(days, 0.5)").alias("median_days"), F.max("days").alias("longest"))
_add("agg23_swing_census", lambda s, d: rounded(_census(s, d)), _SWINGS + " SELECT pair_id, direction, count(*) n, round(median(move), 6) median_move, median(days) median_days, max(days) longest FROM swings GROUP BY 1, 2")
_ENTRIES = _WALK + ", pct AS (SELECT a.pair_id, a.rn FROM walk a JOIN walk b ON a.pair_id = b.pair_id AND b.rn <= a.rn GROUP BY 1, 2 HAVING count(*) >= 504 AND avg(CASE WHEN b.pi <= a.pi THEN 1.0 ELSE 0.0 END) >= 0.9), f AS (SELECT pair_id, rn, pi, lead(pi, 60) OVER w ahead, max(pi) OVER (PARTITION BY pair_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING) - pi worst FROM walk WINDOW w AS (PARTITION BY pair_id ORDER BY rn)), entries AS (SELECT pair_id, rn, pi - ahead gain, worst FROM f JOIN pct USING (pair_id, rn) WHERE ahead IS NOT NULL), br AS (SELECT * FROM (VALUES ('low', 250.0), ('mid', 600.0), ('high', 1200.0)) t(bracket, annual))"
_add("agg24_entry_outcomes", lambda s, d: rounded(T.entry_outcomes(T.entries(_walk(s, d), 0.9, 60), 60)),
     _ENTRIES + ", n AS (SELECT pair_id, bracket, (gain - (annual + 7 * 252 / 60.0) / 1e4 * 60 / 252) * 100 net, worst * 100 worst FROM entries, br) SELECT pair_id, bracket, count(*) n, round(quantile_cont(net, 0.25), 6) q25_net, round(quantile_cont(net, 0.5), 6) median_net, round(quantile_cont(net, 0.75), 6) q75_net, round(avg((net > 0)::INT), 6) beats_carry, round(quantile_cont(worst, 0.5), 6) median_worst, round(quantile_cont(worst, 0.95), 6) p95_worst FROM n GROUP BY 1, 2")
_add("agg25_stop_survival", lambda s, d: rounded(T.stop_survival(T.entries(_walk(s, d), 0.9, 60), [2.5, 5.0, 10.0])),
     _ENTRIES + " SELECT pair_id, stop, count(*) n, round(avg((worst * 100 >= stop)::INT), 6) stopped, round(avg((worst * 100 >= stop AND gain > 0)::INT), 6) stopped_but_won FROM entries, (SELECT unnest([2.5, 5.0, 10.0])::DOUBLE AS stop) GROUP BY 1, 2")
_BREAK = ", g AS (SELECT pair_id, date, pi, days, bracket, annual + 7 * 252.0 / days carry_bp FROM panel, (SELECT unnest([63, 252]) AS days) hz, (VALUES ('low', 250.0), ('mid', 600.0), ('high', 1200.0)) t(bracket, annual)), h AS (SELECT *, carry_bp / 1e4 * days / 252 need, pi - 0.0007 room FROM g), k AS (SELECT *, CASE WHEN room > 0 AND need < room THEN -days / log2(1 - need / room) END half_life FROM h)"
_add("grd03_breakeven_surface", lambda s, d: rounded(T.breakeven(panel(s, d).select("pair_id", "date", "pi"), [63, 252]).groupBy("pair_id", "days", "bracket").agg(F.count_if(F.col("half_life").isNull()).alias("unreachable"), F.expr("percentile(half_life, 0.5)").alias("median_half_life"), F.max("carry_bp").alias("carry_bp")), 5),
     _BREAK + " SELECT pair_id, CAST(days AS BIGINT) AS days, bracket, CAST(count_if(half_life IS NULL) AS BIGINT) unreachable, round(median(half_life), 5) median_half_life, round(max(carry_bp)::DOUBLE, 5) carry_bp FROM k GROUP BY 1, 2, 3")
_add("grd04_critical_carry", lambda s, d: rounded(T.critical_carry(panel(s, d).select("pair_id", "date", "pi"), 300.0, 252), 4),
     " SELECT pair_id, date, round(pi, 4) pi, round(1e4 * (pi - 0.0007) * (1 - pow(2, -252 / 300.0)) * 252 / 252 - 7.0 * 252 / 252, 4) critical_bp FROM panel")
_add("agg35_netting", lambda s, d: rounded(T.netting(panel(s, d), RATIO)),
     f", r AS (SELECT pair_id, ln(adr / lag(adr) OVER w) a, ln(({RATIO} * local / fx) / lag({RATIO} * local / fx) OVER w) l, ln((1 + pi) / lag(1 + pi) OVER w) g FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date)), v AS (SELECT pair_id, count(*) n, stddev_samp(a) * sqrt(252) vol_adr, stddev_samp(l) * sqrt(252) vol_local, stddev_samp(g) * sqrt(252) vol_pair FROM r GROUP BY 1) SELECT pair_id, n, round(vol_adr, 6) vol_adr, round(vol_local, 6) vol_local, round(vol_pair, 6) vol_pair, round(vol_pair / (vol_adr + vol_local), 6) ratio FROM v")
_add("agg40_stress_session", lambda s, d: rounded(T.stress_session(panel(s, d))),
     ", r AS (SELECT *, (high - low) / adr span FROM panel) SELECT pair_id, arg_max(date, (span, date)) AS date, round(max(span), 6) widest, round(max(span) / nullif(median(span), 0), 6) multiple, round(arg_max(volume, (span, date)) / nullif(avg(volume), 0), 6) volume_multiple FROM r GROUP BY 1")
_add("prj08_margin_stress", lambda s, d: rounded(T.margin_stress(panel(s, d))),
     ", r AS (SELECT pair_id, arg_min(pi, date) AS entry, max(pi) peak, arg_max(rn, (pi, -rn)) top FROM panel GROUP BY 1) SELECT r.pair_id, round(entry, 6) AS entry, round(peak, 6) peak, p.date peak_date, top - 1 AS sessions, round(peak - entry, 6) rise FROM r JOIN panel p ON p.pair_id = r.pair_id AND p.rn = top")
_add("win18_fx_states", lambda s, d: rounded(T.fx_states(panel(s, d), 20).select("pair_id", "date", "move", "state")),
     ", m AS (SELECT pair_id, date, -(fx / lag(fx, 20) OVER (PARTITION BY pair_id ORDER BY date) - 1) AS move FROM panel), k AS (SELECT * FROM m WHERE move IS NOT NULL), q AS (SELECT pair_id, quantile_cont(move, 1 / 3) a, quantile_cont(move, 2 / 3) b FROM k GROUP BY 1) SELECT pair_id, date, round(move, 6) AS move, CASE WHEN move <= a THEN 'weakness' WHEN move <= b THEN 'neutral' ELSE 'strength' END state FROM k JOIN q USING (pair_id)")
_HAC = _WALK + """, x AS (SELECT pair_id, rn, pi - avg(pi) OVER (PARTITION BY pair_id) x FROM walk), j AS (SELECT a.pair_id, h, a.rn, a.x, b.x y FROM x a, (SELECT unnest([1, 5, 20, 60]) h) k, x b WHERE a.pair_id = b.pair_id AND b.rn = a.rn + h),
g AS (SELECT pair_id, h, count(*) n, avg(x) mx, avg(y) my, var_pop(x) * count(*) sxx, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-4) rho FROM j GROUP BY 1, 2),
u AS (SELECT pair_id, h, rn, (x - mx) * (y - my - rho * (x - mx)) u FROM j JOIN g USING (pair_id, h)),
cross_ AS (SELECT a.pair_id, a.h, sum(2 * (1 - (a.rn - b.rn) / (a.h + 1.0)) * a.u * b.u) s FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.h = b.h AND b.rn BETWEEN a.rn - a.h AND a.rn - 1 GROUP BY 1, 2),
meat AS (SELECT pair_id, h, sum(u * u) + coalesce(any_value(s), 0) m FROM u LEFT JOIN cross_ USING (pair_id, h) GROUP BY 1, 2),
path AS (SELECT pair_id, h, n, rho, sqrt(greatest(m, 0)) / nullif(sxx, 0) se FROM g JOIN meat USING (pair_id, h))"""
_add("agg13_kernel_errors", lambda s, d: rounded(I.projections(_walk(s, d), HORIZONS), 5), _HAC + " SELECT pair_id, CAST(h AS BIGINT) h, n, round(rho, 5) rho, round(se, 5) se FROM path")
_add("agg14_half_lives", lambda s, d: rounded(I.half_lives(I.projections(_walk(s, d), HORIZONS), 12.0), 4),
     _HAC + """, c AS (SELECT *, rho - 1.96 * se lo, rho + 1.96 * se hi, n / h spans FROM path), t AS (SELECT pair_id, h, unnest(['rho', 'lo', 'hi']) k, unnest([rho, lo, hi]) v, spans FROM c),
    n AS (SELECT *, lead(v) OVER w v1, lead(h) OVER w h1, lead(spans) OVER w s1 FROM t WINDOW w AS (PARTITION BY pair_id, k ORDER BY h)), crossed AS (SELECT *, (v - 0.5) / (v - v1) f FROM n WHERE v >= 0.5 AND v1 < 0.5),
    y AS (SELECT pair_id, k, arg_min(h + f * (h1 - h), h) AS crossing, arg_min(spans + f * (s1 - spans), h) spans FROM crossed GROUP BY 1, 2),
    s AS (SELECT pair_id, count(*) fits, min(h) h0, arg_min(rho, h) r0, arg_min(hi, h) u0, count_if(rho > 1e-6) pos, regr_slope(ln(rho), h) FILTER (rho > 1e-6) slope FROM (SELECT pair_id, h, CASE WHEN rho > 1e-6 THEN rho ELSE NULL END rho_, rho, hi FROM c) GROUP BY 1),
    a AS (SELECT s.*, p.crossing point, p.spans, l.crossing AS lower, q.crossing AS upper FROM s LEFT JOIN y p ON p.pair_id = s.pair_id AND p.k = 'rho' LEFT JOIN y l ON l.pair_id = s.pair_id AND l.k = 'lo' LEFT JOIN y q ON q.pair_id = s.pair_id AND q.k = 'hi'),
    r AS (SELECT pair_id, CASE WHEN fits < 3 THEN 'none' WHEN r0 < 0.5 THEN 'sub_resolution' WHEN point IS NOT NULL AND spans >= 12 THEN 'interpolated' WHEN point IS NOT NULL THEN 'interpolated_underpowered' WHEN pos >= 3 AND slope < 0 THEN 'extrapolated' ELSE 'none' END support,
      CASE WHEN fits < 3 THEN NULL WHEN r0 < 0.5 THEN h0 WHEN point IS NOT NULL THEN point WHEN pos >= 3 AND slope < 0 THEN -ln(2) / slope END point, CASE WHEN fits < 3 THEN NULL WHEN r0 < 0.5 THEN 0 ELSE lower END AS lower, CASE WHEN fits < 3 THEN NULL WHEN r0 < 0.5 THEN CASE WHEN u0 < 0.5 THEN h0 END ELSE upper END AS upper FROM a)
    SELECT pair_id, support, round(point, 4) point, round(lower, 4) AS lower, round(upper, 4) AS upper, upper IS NULL AND support <> 'none' unbounded_above FROM r""")
_FOLDS = ", b AS (SELECT pair_id, date, rn - 1 i, count(*) OVER (PARTITION BY pair_id) n FROM panel), e AS (SELECT *, fold * (n // 5) + least(fold, n % 5) a, (fold + 1) * (n // 5) + least(fold + 1, n % 5) - 1 z FROM b, (SELECT unnest([0, 1, 2, 3, 4]) fold)), f AS (SELECT pair_id, fold, CASE WHEN i >= a AND i <= z THEN 'test' WHEN i < a AND i + 4 >= a THEN 'purged' WHEN i > z AND i <= z + 10 THEN 'embargoed' ELSE 'train' END AS role FROM e WHERE a <= z)"
_add("win15_purged_folds", lambda s, d: rounded(I.purged_folds(panel(s, d), 5, 5, 10).groupBy("pair_id", "fold", "role").agg(F.count("*").alias("n"))), _FOLDS + " SELECT pair_id, CAST(fold AS BIGINT) fold, role, count(*) n FROM f GROUP BY 1, 2, 3")
_add("win16_placebo", lambda s, d: rounded(I.placebo(panel(s, d), "7")),
     ", k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY md5('7|' || pair_id || '|' || strftime(date, '%Y-%m-%d'))) dealt FROM panel) SELECT a.pair_id, a.date, round(b.pi, 6) placebo FROM panel a JOIN k b ON b.pair_id = a.pair_id AND b.dealt = a.rn")
_add("agg31_long_run_t", lambda s, d: rounded(I.long_run_t(_walk(s, d), 5), 4),
     _WALK + ", y AS (SELECT pair_id, rn - 1 rn, lead(pi, 5) OVER (PARTITION BY pair_id ORDER BY rn) - pi y FROM walk), k AS (SELECT *, y - avg(y) OVER (PARTITION BY pair_id) u FROM y WHERE y IS NOT NULL), c AS (SELECT a.pair_id, sum(2 * (1 - (a.rn - b.rn) / 6.0) * a.u * b.u) s FROM k a JOIN k b ON a.pair_id = b.pair_id AND b.rn BETWEEN a.rn - 5 AND a.rn - 1 GROUP BY 1) SELECT pair_id, count(*) n, count(*) FILTER (rn % 5 = 0) blocks, round(avg(y) / nullif(stddev_samp(y) / sqrt(count(*)), 0), 4) t_naive, round(avg(y) / nullif(sqrt((sum(u * u) + coalesce(any_value(s), 0)) / count(*)) / sqrt(count(*)), 0), 4) t_hac, round(avg(y) FILTER (rn % 5 = 0) / nullif(stddev_samp(y) FILTER (rn % 5 = 0) / sqrt(count(*) FILTER (rn % 5 = 0)), 0), 4) t_blocks FROM k LEFT JOIN c USING (pair_id) GROUP BY 1")


def _strata(s, d):
    """Order priorities as strata: status F or O against even or odd customers."""
    state, local = F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0
    rows = read(s, d, "orders").where("o_orderstatus in ('F', 'O')")
    return rows.groupBy("o_orderpriority").agg(F.count_if(state & local).alias("a"), F.count_if(state & ~local).alias("b"), F.count_if(~state & local).alias("c"), F.count_if(~state & ~local).alias("d"))


_STRATA = "WITH t AS (SELECT o_orderpriority, count_if(o_orderstatus = 'F' AND o_custkey % 2 = 0)::BIGINT a, count_if(o_orderstatus = 'F' AND o_custkey % 2 <> 0)::BIGINT b, count_if(o_orderstatus = 'O' AND o_custkey % 2 = 0)::BIGINT c, count_if(o_orderstatus = 'O' AND o_custkey % 2 <> 0)::BIGINT d FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)"
_TAIL = "(1 / (1 + 0.3275911 * x))"
_ERFC = f"(((((1.061405429 * {_TAIL} - 1.453152027) * {_TAIL} + 1.421413741) * {_TAIL} - 0.284496736) * {_TAIL} + 0.254829592) * {_TAIL} * exp(-x * x))"
_add("agg30_mantel_haenszel", lambda s, d: rounded(I.mantel_haenszel(_strata(s, d))),
     _STRATA + f", m AS (SELECT count(*) strata, sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)) odds_ratio, pow(abs(sum(a) - sum((a + b) * (a + c) / (a + b + c + d))) - 0.5, 2) / sum((a + b)::DOUBLE * (c + d) * (a + c) * (b + d) / (pow(a + b + c + d, 2) * (a + b + c + d - 1))) chi2 FROM t), n AS (SELECT *, sqrt(chi2) / sqrt(2) x FROM m) SELECT strata, round(odds_ratio, 6) odds_ratio, round(chi2, 6) chi2, round({_ERFC}, 6) p FROM n", raw=True)
_add("agg28_two_proportions", lambda s, d: rounded(I.two_proportions(_strata(s, d).select("o_orderpriority", F.col("a").alias("k1"), F.expr("a + b").alias("n1"), F.col("c").alias("k2"), F.expr("c + d").alias("n2")))),
     _STRATA + f", g AS (SELECT o_orderpriority, a k1, a + b n1, c k2, c + d n2, a / nullif(a + b, 0) p1, c / nullif(c + d, 0) p2, (a + c) / (a + b + c + d) q FROM t), z AS (SELECT *, (p1 - p2) / nullif(sqrt(q * (1 - q) * (1 / nullif(n1, 0) + 1 / nullif(n2, 0))), 0) z FROM g), y AS (SELECT *, abs(z) / sqrt(2) x FROM z) SELECT o_orderpriority, k1, n1, k2, n2, round(p1, 6) p1, round(p2, 6) p2, round(z, 6) z, round({_ERFC}, 6) p, CASE WHEN n1 < 10 OR n2 < 10 THEN 'UNTESTABLE' WHEN (p1 - p2) * 100 >= 10 AND {_ERFC} < 0.05 THEN 'HELD' ELSE 'NULL' END verdict FROM y", raw=True)
