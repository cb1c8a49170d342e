"""Queries of variants, providers, coverage, instants and hedges over a registry derived from regions, each beside its oracle SQL.

A region's pair is measured from the series REGION.A and REGION.N; the one of ASIA has several FX legs.  Nations are registered as
pairs too, and no data land for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import variants as V
from twinleg.operators.series import by_pair
from twinleg.plans.panel import BASE, panel, rounded
from twinleg.sources.tables import RATIO, daily_bars, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FX_LEGS, START, MOVES = {"spot": "fx.spot", "noon": "fx.noon"}, "1993-01-01", [-0.01, 0.01]


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


def _pairs(s, d):
    regions = read(s, d, "region").selectExpr(
        "r_name AS pair_id", "r_name || '.A' AS adr", "r_name || '.N' AS local", "'fx.' || r_name AS fx", f"{RATIO}D AS ratio", "r_name = 'ASIA' AS many_fx",
        "if(r_regionkey = 1, DATE'1994-01-01', NULL) AS sample_start", "if(r_regionkey = 3, DATE'1997-12-31', NULL) AS sample_end",
        "if(r_regionkey = 1, 'Listed anew. Older rows are another share.', if(r_regionkey = 3, 'Delisted', NULL)) AS sample_reason",
        "r_regionkey % 2 = 0 AS confirmed", "r_regionkey = 2 AS forward_test", "r_regionkey = 3 AS excluded", "CASE r_regionkey WHEN 0 THEN 'constrained' WHEN 1 THEN 'fungible' END AS class")
    nations = read(s, d, "nation").selectExpr(
        "n_name AS pair_id", "n_name || '.A' AS adr", "n_name || '.N' AS local", "'fx.' || n_name AS fx", "1.0D AS ratio", "false AS many_fx", "CAST(NULL AS DATE) AS sample_start", "CAST(NULL AS DATE) AS sample_end",
        "CAST(NULL AS STRING) AS sample_reason", "false AS confirmed", "false AS forward_test", "n_nationkey % 10 = 0 AS excluded", "CAST(NULL AS STRING) AS class")
    return regions.unionByName(nations)


def _closes(s, d):
    """(series_id, close_def, date, close): the official close of every flag, and the middle of the range of pairs whose name holds
    an A as the consolidated one."""
    rows = daily_bars(s, d).withColumn("series_id", F.concat_ws(".", "pair_id", "leg"))
    kinds = F.array(F.struct(F.lit("primary_official").alias("k"), F.col("close").alias("v")), F.struct(F.lit("consolidated").alias("k"), F.when(F.contains("pair_id", F.lit("A")), (F.col("high") + F.col("low")) / 2).alias("v")))
    return rows.select("series_id", "date", F.explode(kinds).alias("c")).select("series_id", F.col("c.k").alias("close_def"), "date", F.col("c.v").alias("close")).where("close is not null")


def _mean_price(orders, series):
    return orders.groupBy(F.lit(series).alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("fx"))


def _fx(s, d):
    """Shared legs fx.spot (all orders) and fx.noon (finished orders); own legs of two regions; all other native legs fall back on the
    shared table, which holds every region's."""
    orders = read(s, d, "orders")
    own = orders.where("o_custkey % 5 < 2").groupBy(F.expr("'fx.' || if(o_custkey % 5 = 0, 'AFRICA', 'EUROPE')").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("fx"))
    spot = _mean_price(orders, "fx.spot")
    shared = spot.unionByName(_mean_price(orders.where("o_orderstatus = 'F'"), "fx.noon"))
    for name in ("AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"):
        shared = shared.unionByName(spot.withColumn("series_id", F.lit(f"fx.{name}")))
    return V.with_fallback(own, shared)


_REGISTRY = f""", reg AS (SELECT r_name AS pair_id, r_name || '.A' AS adr, r_name || '.N' AS lcl, 'fx.' || r_name AS fxs, {RATIO} AS ratio, r_name = 'ASIA' AS many,
    CASE WHEN r_regionkey = 1 THEN DATE '1994-01-01' END AS sample_start, CASE WHEN r_regionkey = 3 THEN DATE '1997-12-31' END AS sample_end,
    CASE r_regionkey WHEN 1 THEN 'Listed anew' WHEN 3 THEN 'Delisted' END AS restriction, r_regionkey % 2 = 0 AS confirmed, r_regionkey AS k FROM region
  UNION ALL SELECT n_name, n_name || '.A', n_name || '.N', 'fx.' || n_name, 1.0, false, NULL, NULL, NULL, false, 100 + n_nationkey FROM nation),
cls AS (SELECT pair_id || '.' || leg AS sid, date, unnest(['primary_official', 'consolidated']) AS close_def, unnest([close, CASE WHEN contains(pair_id, 'A') THEN (high + low) / 2 END]) AS c FROM bars),
o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS p, o_orderstatus AS st, o_custkey % 5 AS m FROM orders),
sfx AS (SELECT 'own' AS source, CASE m WHEN 0 THEN 'fx.AFRICA' ELSE 'fx.EUROPE' END AS sid, date, avg(p) AS fx FROM o WHERE m < 2 GROUP BY 1, 2, 3
  UNION ALL SELECT 'shared', 'fx.noon', date, avg(p) FROM o WHERE st = 'F' GROUP BY 1, 2, 3
  UNION ALL SELECT 'shared', n, date, avg(p) FROM o, (SELECT unnest(['fx.spot', 'fx.AMERICA', 'fx.MIDDLE EAST']) AS n) GROUP BY 1, 2, 3)"""
_VARIANTS = _REGISTRY + """, ax AS (SELECT pair_id, 'native' AS fx_leg, fxs AS sid FROM reg WHERE NOT many UNION ALL SELECT pair_id, unnest(['spot', 'noon']), unnest(['fx.spot', 'fx.noon']) FROM reg WHERE many),
ok AS (SELECT reg.*, greatest(coalesce(sample_start, DATE '1993-01-01'), DATE '1993-01-01') AS lo, coalesce(sample_end, DATE '9999-12-31') AS hi FROM reg),
sa AS (SELECT pair_id, close_def, date, c FROM ok JOIN cls ON sid = adr WHERE c IS NOT NULL AND date BETWEEN lo AND hi),
sb AS (SELECT pair_id, close_def, date, c FROM ok JOIN cls ON sid = lcl WHERE c IS NOT NULL AND date BETWEEN lo AND hi),
sf AS (SELECT pair_id, fx_leg, sid, date, fx, ratio FROM ok JOIN ax USING (pair_id) JOIN sfx USING (sid) WHERE date BETWEEN lo AND hi),
vr AS (SELECT sa.pair_id, fx_leg, sa.close_def, sa.date, sa.c AS adr, sb.c AS lcl, fx, sa.c * fx / (ratio * sb.c) - 1 AS pi
  FROM sa JOIN sb ON sa.pair_id = sb.pair_id AND sa.date = sb.date AND sa.close_def = sb.close_def JOIN sf ON sf.pair_id = sa.pair_id AND sf.date = sa.date),
na AS (SELECT pair_id, close_def, count(*) AS a FROM sa GROUP BY 1, 2), nb AS (SELECT pair_id, close_def, count(*) AS b FROM sb GROUP BY 1, 2), nf AS (SELECT pair_id, fx_leg, sid, count(*) AS f FROM sf GROUP BY 1, 2, 3),
vt AS (SELECT v.*, greatest(a, b, f) - n AS dropped, sid AS fx_series, confirmed FROM (SELECT pair_id, fx_leg, close_def, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM vr GROUP BY 1, 2, 3) v
  JOIN na USING (pair_id, close_def) JOIN nb USING (pair_id, close_def) JOIN nf USING (pair_id, fx_leg) JOIN reg USING (pair_id))"""
_table = lambda s, d: V.variant_table(_closes(s, d), _fx(s, d), _pairs(s, d), FX_LEGS, START)
_add("src03_shared_fx", lambda s, d: rounded(_fx(s, d).select("source", "series_id", "date", "fx")), _REGISTRY + " SELECT source, sid AS series_id, date, round(fx, 6) AS fx FROM sfx")
_add("join02_variants", lambda s, d: rounded(V.all_variants(_closes(s, d), _fx(s, d), _pairs(s, d), FX_LEGS, START).select("pair_id", "fx_leg", "close_def", "date", "pi")),
     _VARIANTS + " SELECT pair_id, fx_leg, close_def, date, round(pi, 6) AS pi FROM vr")
_add("join02_variant_table", lambda s, d: rounded(_table(s, d)), _VARIANTS + " SELECT * FROM vt")
_add("agg09_panel_coverage", lambda s, d: rounded(V.panel_coverage(_pairs(s, d), _table(s, d), list(FX_LEGS))),
     _VARIANTS + """, f AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY CASE fx_leg WHEN 'spot' THEN 1 WHEN 'noon' THEN 2 ELSE 3 END, close_def DESC) = 1)
SELECT reg.pair_id, CASE WHEN k = 2 THEN 'forward test (never fitted)' WHEN k = 3 OR k >= 100 AND k % 10 = 0 THEN 'excluded' WHEN k = 0 THEN 'constrained' WHEN k = 1 THEN 'fungible'
    WHEN n > 0 THEN 'candidate: classification withheld' ELSE 'unreachable: no data landed' END AS label, coalesce(n, 0) AS n, first_date, last_date, ratio::DOUBLE AS ratio, reg.confirmed, sample_start, sample_end, restriction
FROM reg LEFT JOIN f USING (pair_id)""")


def _offers(s, d):
    """(series_id, provider, date, close): closes of a region's month by flag, which stands for the provider;
    flag A has nothing for ASIA."""
    rows = daily_bars(s, d).where("leg <> 'A' or pair_id <> 'ASIA'")
    return rows.select("pair_id", F.col("leg").alias("provider"), "date", "close").withColumn("series_id", F.concat_ws(".", "pair_id", F.month("date").cast("string")))


def _chain(s, d):
    """Months of each region: odd ones ask for A, then R; even ones for Z, which has nothing, then N; the twelfth only for Z."""
    return read(s, d, "region").select(F.col("r_name"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")).selectExpr(
        "r_name || '.' || m AS series_id", "posexplode(CASE WHEN m = 12 THEN array('Z') WHEN m % 2 = 1 THEN array('A', 'R') ELSE array('Z', 'N') END) AS (place, provider)")


_CHAIN = """, of AS (SELECT pair_id || '.' || month(date) AS series_id, leg AS provider, date, close FROM bars WHERE leg <> 'A' OR pair_id <> 'ASIA'),
ch AS (SELECT r_name || '.' || m AS series_id, unnest(range(2)) AS place, unnest(CASE WHEN m = 12 THEN ['Z', NULL] WHEN m % 2 = 1 THEN ['A', 'R'] ELSE ['Z', 'N'] END) AS provider FROM region, range(1, 13) AS r(m)),
fs AS (SELECT series_id, provider FROM ch WHERE provider IS NOT NULL AND (series_id, provider) IN (SELECT (series_id, provider) FROM of) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY place) = 1)"""
_add("src04_first_provider", lambda s, d: rounded(V.first_provider(_offers(s, d), _chain(s, d)).select("series_id", "provider", "date", "close")),
     _CHAIN + " SELECT series_id, provider, date, round(close, 6) AS close FROM of JOIN fs USING (series_id, provider)")
_add("src04_unserved", lambda s, d: V.unserved(_offers(s, d), _chain(s, d)),
     _CHAIN + " SELECT series_id, string_agg(provider, ' > ' ORDER BY place) AS tried FROM ch WHERE provider IS NOT NULL AND series_id NOT IN (SELECT series_id FROM fs) GROUP BY 1")


def _clocks(s, d):
    return read(s, d, "region").selectExpr("r_name || '.A' AS series_id", "'America/New_York' AS timezone", "'16:00' AS close_local", "15 AS lag_min").unionByName(
        read(s, d, "region").select("r_name", F.explode(F.array(F.lit(".N"), F.lit(".R"))).alias("leg")).selectExpr("r_name || leg AS series_id", "'Asia/Seoul' AS timezone", "'15:30' AS close_local", "1080 AS lag_min"))


_add("prj04_instants", lambda s, d: V.instants(_closes(s, d).where("close_def = 'primary_official'").select("series_id", "date"), _clocks(s, d)).select("series_id", "date", F.unix_seconds("observed_at").alias("observed_at"), F.unix_seconds("known_at").alias("known_at")),
     """, t AS (SELECT pair_id || '.' || leg AS series_id, leg, date,
    CASE WHEN date >= make_date(year(date), 4, 1) + CAST((7 - dayofweek(make_date(year(date), 4, 1))) % 7 AS INT) AND date < make_date(year(date), 10, 31) - CAST(dayofweek(make_date(year(date), 10, 31)) AS INT) THEN 4 ELSE 5 END AS west FROM bars)
SELECT series_id, date, CASE leg WHEN 'A' THEN epoch(date)::BIGINT + (16 + west) * 3600 ELSE epoch(date)::BIGINT + 23400 END AS observed_at,
  CASE leg WHEN 'A' THEN epoch(date)::BIGINT + (16 + west) * 3600 + 900 ELSE epoch(date)::BIGINT + 88200 END AS known_at FROM t""")
_LAST = ", ll AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY date DESC) = 1)"
_add("prj06_fx_hedge", lambda s, d: rounded(V.fx_hedge(V.last_legs(panel(s, d)), RATIO, 100.0)),
     _LAST + f""" SELECT pair_id, date, round(100 * {RATIO} * local, 6) AS local_notional, round(100 * {RATIO} * local / fx, 6) AS local_usd, round(100 * adr, 6) AS adr_usd,
  round(100 * adr - 100 * {RATIO} * local / fx, 6) AS residual_usd, round(1 - {RATIO} * local / fx / adr, 6) AS residual_share, 0.0::DOUBLE AS identity_error FROM ll""")


def _coefficients(s, d):
    """(pair_id, coef, low, high): slope of the gap's log changes on FX's, 1.96 errors to either side."""
    step = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by_pair())
    rows = panel(s, d).withColumn("gap", 1 + F.col("pi")).select("pair_id", step(F.col("gap")).alias("y"), step(F.col("fx")).alias("x")).where("x is not null and y is not null")
    sums = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("coef"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    error = F.expr("1.96D * sqrt(greatest(syy - coef * sxy, 0.0D) / nullif(n - 2, 0) / sxx)")
    return sums.select("pair_id", "coef", (F.col("coef") - error).alias("low"), (F.col("coef") + error).alias("high"))


_add("prj07_fx_sensitivity", lambda s, d: rounded(V.fx_sensitivity(V.last_legs(panel(s, d)), _coefficients(s, d), MOVES), 5),
     _LAST + """, st AS (SELECT pair_id, ln(1 + pi) - lag(ln(1 + pi)) OVER w AS y, ln(fx) - lag(ln(fx)) OVER w AS x FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date)),
rg AS (SELECT pair_id, regr_slope(y, x) AS b, 1.96 * sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / nullif(count(*) - 2, 0) / regr_sxx(y, x)) AS e FROM st WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
mv AS (SELECT ll.pair_id, date, pi, move, 100 * (1 + pi) * move AS a, b, e FROM ll LEFT JOIN rg USING (pair_id), (SELECT unnest([-0.01, 0.01])::DOUBLE AS move))
SELECT pair_id, date, round(pi, 5) AS pi, move, round(a, 5) AS analytic_pp, round(b * a, 5) AS central_pp, round(b * a - e * abs(a), 5) AS low_pp, round(b * a + e * abs(a), 5) AS high_pp FROM mv""")
