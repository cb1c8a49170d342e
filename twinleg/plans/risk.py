"""Queries of pair risk, capacity, sizing and pooled persistence, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import premium as P
from twinleg.operators import risk as R
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import daily_bars, daily_fx, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIZES, SHARES, NOTIONALS, BUDGETS = [25e6, 100e6, 1e9], [500, 1000, 2000], [25e6, 1e8], [3.0, 5.0, 10.0]
HORIZONS = R.horizon_grid()


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


_RETURNS = """, r AS (SELECT pair_id, date, pi, ln(adr) - lag(ln(adr)) OVER w ra, ln(local / fx) - lag(ln(local / fx)) OVER w rl,
    ln(1 + pi) - lag(ln(1 + pi)) OVER w rp, ln(local) - lag(ln(local)) OVER w rlocal, ln(fx) - lag(ln(fx)) OVER w rfx
  FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date))"""
_VARIANCE = _RETURNS + """, v AS (SELECT pair_id, count(*) n, var_samp(ra) t, var_samp(rlocal) l, var_samp(rfx) f, var_samp(rp) g,
    covar_samp(rlocal, rfx) lf, covar_samp(rlocal, rp) lg, covar_samp(rfx, rp) fg FROM r WHERE ra IS NOT NULL GROUP BY 1),
s AS (SELECT pair_id, n, t var_adr, l / t share_local, f / t share_fx, g / t share_gap, -2 * lf / t share_local_fx, 2 * lg / t share_local_gap,
    -2 * fg / t share_fx_gap, round(abs(t - (l + f + g - 2 * lf + 2 * lg - 2 * fg)), 6) residual, n < 30 descriptive, lg < -0.25 * g absorbing FROM v)"""
_SHARES = ["var_adr", "share_local", "share_fx", "share_gap", "share_local_fx", "share_local_gap", "share_fx_gap"]
_add("agg06_return_variance", lambda s, d: rounded(R.return_variance(panel(s, d))),
     _VARIANCE + " SELECT pair_id, n, " + ", ".join(f"round({c}, 6) {c}" for c in _SHARES) + ", residual, descriptive, absorbing FROM s")
_add("agg07_panel_contrast",
     lambda s, d: rounded(R.return_variance(panel(s, d)).agg(F.count("*").alias("pairs"), F.max("share_gap").alias("most"), F.min("share_gap").alias("least"), F.max_by("pair_id", "share_gap").alias("most_pair"), F.min_by("pair_id", "share_gap").alias("least_pair"))),
     _VARIANCE + " SELECT count(*) pairs, round(max(share_gap), 6) most, round(min(share_gap), 6) least, max_by(pair_id, share_gap) most_pair, min_by(pair_id, share_gap) least_pair FROM s")
_add("agg36_stress_volatility", lambda s, d: rounded(R.stress_volatility(panel(s, d))),
     _RETURNS + """, k AS (SELECT pair_id, quantile_cont(abs(rp), 0.8) cut FROM r WHERE rp IS NOT NULL GROUP BY 1),
v AS (SELECT pair_id, abs(rp) > cut stress, count(*) n, stddev_samp(ra) * sqrt(252) a, stddev_samp(rl) * sqrt(252) l, stddev_samp(rp) * sqrt(252) p FROM r JOIN k USING (pair_id) WHERE rp IS NOT NULL GROUP BY 1, 2)
SELECT pair_id, stress, n, round(a, 6) vol_adr, round(l, 6) vol_local, round(p, 6) vol_pair, round(p / nullif(a + l, 0), 6) ratio FROM v""")
_CALLS = _RETURNS + """, m AS (SELECT pair_id, date, pi, 1.645 * stddev_samp(rp) OVER p im, 1.645 * (stddev_samp(ra) OVER p + stddev_samp(rl) OVER p) ims,
    greatest(sum(coalesce(rp, 0)) OVER o, 0) lp, greatest(sum(coalesce(ra, 0) - coalesce(rl, 0)) OVER o, 0) ls
  FROM r WINDOW p AS (PARTITION BY pair_id), o AS (PARTITION BY pair_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
calls AS (SELECT pair_id, date, pi, im + lp total_pair, ims + ls total_standalone FROM m)"""
_add("win12_margin_calls", lambda s, d: rounded(R.margin_calls(panel(s, d))),
     _CALLS + " SELECT pair_id, date, round(pi, 6) pi, round(total_pair, 6) total_pair, round(total_standalone, 6) total_standalone FROM calls")
_add("win13_peak_calls", lambda s, d: rounded(R.peak_calls(R.margin_calls(panel(s, d)), NOTIONALS), 2),
     _CALLS + """, k AS (SELECT pair_id, count(*) sessions, min_by(pi, date) start_pi, max(pi) peak_pi, max(total_pair) p, max(total_standalone) t FROM calls GROUP BY 1)
SELECT pair_id, notional, sessions, round(start_pi, 2) start_pi, round(peak_pi, 2) peak_pi, round(p * notional, 2) pair_usd, round(t * notional, 2) standalone_usd, round(p / t, 2) pair_vs_standalone
FROM k, (SELECT unnest([25e6, 1e8])::DOUBLE notional)""")
_add("agg40_stress_liquidity", lambda s, d: rounded(R.stress_liquidity(daily_bars(s, d))),
     """, q AS (SELECT *, (high - low) / close * 100 AS rg, CASE WHEN count(volume) OVER w >= 5 THEN volume / avg(volume) OVER w END rel FROM bars WINDOW w AS (PARTITION BY pair_id, leg ORDER BY date ROWS 62 PRECEDING)),
t AS (SELECT pair_id, leg, date, rg, rel, row_number() OVER (PARTITION BY pair_id, leg ORDER BY rg DESC, date) k FROM q), g AS (SELECT pair_id, leg, count(*) n, median(rg) mid FROM q GROUP BY 1, 2)
SELECT pair_id, leg, n, date stress_date, round(rg, 6) stress_range, round(mid, 6) median_range, round(rg / nullif(mid, 0), 6) range_multiple, round(rel, 6) volume_vs_trailing FROM t JOIN g USING (pair_id, leg) WHERE k = 1""")
_add("prj05_residual_share", lambda s, d: rounded(R.residual_share(panel(s, d))),
     ", q AS (SELECT pair_id, pi / (1 + pi) r FROM panel) SELECT pair_id, count(*) n, round(median(r), 6) median_share, round(quantile_cont(r, 0.95), 6) p95_share, round(max(r), 6) max_share FROM q GROUP BY 1")
_ADV = """, u AS (
  SELECT pair_id, leg, date, close * volume / CASE WHEN leg = 'N' THEN last_value(fx IGNORE NULLS) OVER (PARTITION BY pair_id, leg ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 1 END AS usd
  FROM bars LEFT JOIN fx USING (date) WHERE leg IN ('A', 'N')),
a AS (SELECT *, CASE WHEN count(usd) OVER w >= 3 THEN avg(usd) OVER w END AS adv FROM u WINDOW w AS (PARTITION BY pair_id, leg ORDER BY date ROWS 19 PRECEDING)),
adv AS (SELECT pair_id, leg, count(adv) AS n, min(date) AS first_date, max(date) AS last_date, arg_max(adv, date) AS adv FROM a WHERE adv IS NOT NULL GROUP BY 1, 2)"""
_adv = lambda s, d: R.dollar_adv(daily_bars(s, d), daily_fx(s, d))
_add("agg37_dollar_adv", lambda s, d: rounded(_adv(s, d)),
     _ADV + " SELECT pair_id, leg, n, first_date, last_date, round(adv, 6) adv, CASE WHEN n < 60 THEN 'recent' ELSE 'deep' END caveat FROM adv")
_SIDES = _ADV + """, e AS (SELECT pair_id, max(adv) FILTER (leg = 'A') a, max(adv) FILTER (leg = 'N') l FROM adv GROUP BY 1),
g AS (SELECT pair_id, size_usd, bp, size_usd / (a * bp / 10000) da, size_usd / (l * bp / 10000) dl FROM e, (SELECT unnest([25e6, 100e6, 1e9])::DOUBLE size_usd), (SELECT unnest([500, 1000, 2000]) bp))"""
_add("agg38_days_to_unwind", lambda s, d: rounded(R.days_to_unwind(_adv(s, d), SIZES, SHARES), 3),
     _SIDES + " SELECT pair_id, size_usd, CAST(bp AS BIGINT) participation_bp, round(da, 3) days_adr, round(dl, 3) days_local, round(greatest(da, dl), 3) days_binding, CASE WHEN da >= dl THEN 'adr' ELSE 'local' END binding_leg FROM g")
_add("join22_unwind", lambda s, d: rounded(R.unwind_table(_adv(s, d), SIZES, SHARES), 3),
     _SIDES + """ SELECT pair_id, size_usd, CAST(bp AS BIGINT) AS participation_bp, round(greatest(da, dl), 3) AS sessions_normal,
  round(size_usd / least((SELECT max(adv) FROM adv WHERE adv.pair_id = g.pair_id AND leg = 'A'), (SELECT max(adv) FROM adv WHERE adv.pair_id = g.pair_id AND leg = 'N')) / (bp / 10.0 / 10000), 3) AS sessions_stressed FROM g""")
_AXIS = """, x AS (SELECT pair_id, (max(pi) OVER (PARTITION BY pair_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) - pi) * 100 x, lead(pi, 20) OVER (PARTITION BY pair_id ORDER BY date) ahead FROM panel),
k AS (SELECT pair_id, unnest(['P50', 'P95', 'max']) excursion, unnest([median(x), quantile_cont(x, 0.95), max(x)]) points FROM x WHERE ahead IS NOT NULL GROUP BY pair_id)"""
_add("agg52_excursion_axis", lambda s, d: rounded(R.excursion_axis(panel(s, d), 20)), _AXIS + " SELECT pair_id, excursion, round(points, 6) points FROM k")
_add("grd13_drawdown_budget", lambda s, d: rounded(R.drawdown_budget(R.excursion_axis(panel(s, d), 20), BUDGETS)),
     _AXIS + " SELECT pair_id, excursion, round(points, 6) points, budget, round(budget / points, 6) max_notional FROM k, (SELECT unnest([3.0, 5.0, 10.0])::DOUBLE budget)")
_add("agg10_reconcile_hints", lambda s, d: R.reconcile_hints(P.reconcile(daily_bars(s, d).where("leg = 'N'"), daily_bars(s, d).where("leg = 'R'"), 0.1)),
     """, x AS (SELECT pair_id, date, close x FROM bars WHERE leg = 'N'), y AS (SELECT pair_id, date, close y FROM bars WHERE leg = 'R'),
g AS (SELECT pair_id, abs(x - y) / CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END gap FROM x FULL JOIN y USING (pair_id, date)),
t AS (SELECT pair_id, count(gap) overlap, count(*) FILTER (gap > 0.1) mismatches, max(gap) worst FROM g GROUP BY 1)
SELECT pair_id, overlap, mismatches, CASE WHEN mismatches > 0 THEN CASE WHEN mismatches / greatest(overlap, 1) > 0.9 THEN 'systematic' ELSE 'episodic' END || CASE WHEN worst > 0.5 THEN ',too_large' ELSE '' END
  || CASE WHEN worst > 0.001 AND worst < 0.05 THEN ',small_print' ELSE '' END ELSE '' END hints FROM t""")
_regime = lambda: F.when(F.col("pair_id").isin("ASIA", "EUROPE"), "constrained").otherwise("fungible")
_add("agg12_pooled_projection", lambda s, d: rounded(R.pooled_projection(panel(s, d), _regime(), HORIZONS)),
     """, x AS (SELECT pair_id, rn, CASE WHEN pair_id IN ('ASIA', 'EUROPE') THEN 'constrained' ELSE 'fungible' END regime, pi - avg(pi) OVER (PARTITION BY pair_id) x FROM panel),
j AS (SELECT a.regime, h, a.x, b.x y FROM x a, (SELECT unnest(list_concat(range(1, 21), range(25, 101, 5), range(110, 401, 10))) h) k, x b WHERE a.pair_id = b.pair_id AND b.rn = a.rn + h),
t AS (SELECT regime, h, count(*) n, avg(x) mx, avg(y) my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-4) rho, grouping(regime) pooled FROM j GROUP BY GROUPING SETS ((regime, h), (h)) HAVING count(*) >= 20),
e AS (SELECT t.pooled, t.regime, t.h, sum((j.y - my - rho * (j.x - mx)) ** 2) sse, sum((j.y - my) ** 2) sst FROM t JOIN j ON t.h = j.h AND (t.pooled = 1 OR t.regime = j.regime) GROUP BY 1, 2, 3),
p AS (SELECT *, min(n / h) OVER (PARTITION BY pooled, regime ORDER BY h) room FROM t)
SELECT p.regime, CAST(p.h AS BIGINT) h, n, round(rho, 6) rho, round(my - rho * mx, 6) alpha, round(1 - sse / nullif(sst, 0), 6) r2, n / p.h >= 12 identified
FROM p JOIN e ON p.h = e.h AND p.pooled = e.pooled AND p.regime IS NOT DISTINCT FROM e.regime WHERE room >= 5""")


def _ledger(s, d):
    """SET-05: an append-only ledger of orders against its state of 1998; every 97th row was edited, every 101st lost."""
    rows = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    prior = rows.where("date < '1998-01-01'").select("id", F.sha2(F.concat_ws("|", "id", "cents"), 256).alias("was"))
    now = rows.where("id % 101 <> 0").select("id", F.sha2(F.concat_ws("|", "id", F.expr("cents + if(id % 97 = 0, 1, 0)")), 256).alias("is"))
    both = prior.join(now, "id", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "lost").when(F.col("was") != F.col("is"), "edited").otherwise("unchanged")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("id").cast("long").alias("first_id"))


QUERIES["set05_append_only"] = _ledger
ORACLES["set05_append_only"] = """WITH o AS (SELECT o_orderkey id, CAST(o_orderdate AS DATE) AS date FROM orders),
t AS (SELECT id, CASE WHEN id % 101 = 0 THEN 'lost' WHEN date >= DATE '1998-01-01' THEN 'added' WHEN id % 97 = 0 THEN 'edited' ELSE 'unchanged' END status FROM o WHERE NOT (id % 101 = 0 AND date >= DATE '1998-01-01'))
SELECT status, count(*) n, CAST(min(id) AS BIGINT) first_id FROM t GROUP BY 1"""
