"""Queries over the derived panel, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinleg.operators import premium as P
from twinleg.operators import risk as R
from twinleg.operators import series as S
from twinleg.sources.tables import RATIO, daily_bars, daily_fx, read

BASE = f"""
bars AS (SELECT r_name AS pair_id, l_returnflag AS leg, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) / SUM(l_quantity) AS close,
    MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low, CAST(SUM(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
fx AS (SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS fx FROM orders GROUP BY 1),
legs AS (SELECT a.pair_id, a.date, a.close AS adr, n.close AS local, fx.fx, a.volume, a.high, a.low FROM bars a JOIN bars n ON a.pair_id = n.pair_id AND a.date = n.date AND a.leg = 'A' AND n.leg = 'N' JOIN fx ON fx.date = a.date),
panel AS (SELECT *, adr * fx / ({RATIO} * local) - 1 AS pi, row_number() OVER (PARTITION BY pair_id ORDER BY date) AS rn FROM legs)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_premium(P.join_legs(daily_bars(spark, sf_dir), daily_fx(spark, sf_dir)), RATIO)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and whole numbers as BIGINT, for comparison with the oracle."""
    cast = {"double": lambda c: F.round(c, digits), "int": lambda c: F.col(c).cast("long")}
    return df.select(*(cast.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def _add(name: str, query, body: str, raw: bool = False) -> None:
    QUERIES[name] = query
    ORACLES[name] = body if raw else f"WITH {BASE}{body}"


_add("prj01_premium", lambda s, d: rounded(panel(s, d).select("pair_id", "date", "adr", "local", "fx", "pi")),
     "SELECT pair_id, date, round(adr, 6) adr, round(local, 6) AS local, round(fx, 6) fx, round(pi, 6) pi FROM panel")
_add("agg01_variant_summary", lambda s, d: rounded(P.summary(panel(s, d))),
     "SELECT pair_id, count(*) n, min(date) first_date, max(date) last_date, round(avg(pi), 6) mean_pi, round(min(pi), 6) min_pi, round(max(pi), 6) max_pi, round(max_by(pi, date), 6) last_pi FROM panel GROUP BY 1")


def _join_loss(s, d):
    bars = daily_bars(s, d)
    return P.join_loss(bars, P.join_legs(bars, daily_fx(s, d)))


_add("agg53_join_loss", _join_loss,
     ", r AS (SELECT pair_id, count_if(leg = 'A') adr_rows, count_if(leg = 'N') local_rows FROM bars GROUP BY 1), j AS (SELECT pair_id, count(*) joined FROM panel GROUP BY 1) SELECT pair_id, CAST(adr_rows AS BIGINT) adr_rows, CAST(local_rows AS BIGINT) local_rows, coalesce(joined, 0) joined, CAST(greatest(adr_rows, local_rows) - coalesce(joined, 0) AS BIGINT) dropped FROM r LEFT JOIN j USING (pair_id)")
_add("join05_latest_common", lambda s, d: rounded(P.latest_common(panel(s, d), daily_bars(s, d))),
     ", l AS (SELECT pair_id, max(date) last_date, max_by(pi, date) last_pi FROM panel GROUP BY 1), e AS (SELECT pair_id, max(date) FILTER (leg = 'A') a, max(date) FILTER (leg = 'N') b FROM bars GROUP BY 1) SELECT pair_id, last_date, round(last_pi, 6) last_pi, date_diff('day', last_date, a) adr_fresher, date_diff('day', last_date, b) local_fresher FROM l JOIN e USING (pair_id)")


def _schedule(s, d):
    schedule = s.sql("SELECT * FROM VALUES (DATE'1995-01-01', 1.0D), (DATE'1998-01-01', 2.0D) AS t(from_date, ratio)")
    gaps = s.sql("SELECT DATE'1997-12-20' AS lo, DATE'1998-01-10' AS hi")
    rows = P.scheduled_ratio(panel(s, d).select("pair_id", "date", "pi"), schedule, gaps)
    return rounded(rows.groupBy("pair_id", "ratio").agg(F.count("*").alias("n"), F.avg((F.col("pi") + 1) / F.col("ratio") - 1).alias("mean_pi")))


_add("join03_ratio_schedule", _schedule,
     ", t AS (SELECT pair_id, CASE WHEN date < DATE '1998-01-01' THEN 1.0 ELSE 2.0 END::DOUBLE AS ratio, pi FROM panel WHERE date >= DATE '1995-01-01' AND NOT date BETWEEN DATE '1997-12-20' AND DATE '1998-01-10') SELECT pair_id, ratio, count(*) n, round(avg((pi + 1) / ratio - 1), 6) mean_pi FROM t GROUP BY 1, 2")


def _as_of(s, d):
    bars = daily_bars(s, d)
    facts = bars.where("leg = 'N'").select("pair_id", "date", "close")
    slow = bars.where("leg = 'R' and day(date) <= 3").select("pair_id", "date", F.col("volume").alias("ratio"))
    return rounded(P.as_of(facts, slow, "pair_id", "ratio"))


_add("join04_as_of", _as_of,
     ", f AS (SELECT pair_id, date, close FROM bars WHERE leg = 'N'), w AS (SELECT pair_id, date, volume AS ratio FROM bars WHERE leg = 'R' AND day(date) <= 3) SELECT f.pair_id, f.date, round(f.close, 6) AS close, w.ratio FROM f ASOF LEFT JOIN w ON f.pair_id = w.pair_id AND f.date >= w.date")
_add("join07_reconcile", lambda s, d: rounded(P.reconcile(daily_bars(s, d).where("leg = 'N'"), daily_bars(s, d).where("leg = 'R'"), 0.1)),
     ", x AS (SELECT pair_id, date, close x FROM bars WHERE leg = 'N'), y AS (SELECT pair_id, date, close y FROM bars WHERE leg = 'R'), g AS (SELECT pair_id, x, y, abs(x - y) / CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END gap FROM x FULL JOIN y USING (pair_id, date)) SELECT pair_id, count(gap) overlap, CAST(count_if(y IS NULL) AS BIGINT) only_a, CAST(count_if(x IS NULL) AS BIGINT) only_b, CAST(count_if(gap > 0.1) AS BIGINT) mismatches, round(max(gap), 6) worst, count(gap) > 0 AND count_if(gap > 0.1) = 0 agrees FROM g GROUP BY 1")


def _spread(s, d):
    bars, fx = daily_bars(s, d), daily_fx(s, d)
    both = [P.with_premium(P.join_legs(bars, fx, "A", leg), RATIO).select("pair_id", "date", "pi", F.lit(leg).alias("variant")) for leg in "NR"]
    return rounded(P.variant_spread(both[0].unionByName(both[1])), 3)


_add("join06_variant_spread", _spread,
     f", r AS (SELECT a.pair_id, a.date, a.close * fx.fx / ({RATIO} * n.close) - 1 AS pi FROM bars a JOIN bars n ON a.pair_id = n.pair_id AND a.date = n.date AND a.leg = 'A' AND n.leg = 'R' JOIN fx ON fx.date = a.date), g AS (SELECT pair_id, abs(p.pi - r.pi) * 10000 gap FROM panel p JOIN r USING (pair_id, date)) SELECT pair_id, 'N' a, 'R' b, count(*) n, round(avg(gap), 3) mean_bp, round(quantile_cont(gap, 0.5), 3) median_bp, round(quantile_cont(gap, 0.95), 3) p95_bp, round(max(gap), 3) max_bp FROM g GROUP BY 1")
_PARTS = ", c AS (SELECT pair_id, date, ln(1 + pi) - lag(ln(1 + pi)) OVER w dgap, ln(adr) - lag(ln(adr)) OVER w dadr, ln(fx) - lag(ln(fx)) OVER w dfx, ln(local) - lag(ln(local)) OVER w dlocal FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date)), parts AS (SELECT * FROM c WHERE dgap IS NOT NULL)"
_add("agg02_decomposition", lambda s, d: rounded(P.decomposition(panel(s, d))), _PARTS + " SELECT pair_id, date, round(dgap, 6) dgap, round(dadr, 6) dadr, round(dfx, 6) dfx, round(dlocal, 6) dlocal FROM parts")
_add("agg04_attribution", lambda s, d: rounded(P.attribution(P.decomposition(panel(s, d))), 5),
     _PARTS + " SELECT pair_id, round(max(abs(dadr + dfx - dlocal - dgap)), 5) identity_error, " + ", ".join(f"round(avg(abs(d{c})) * 10000, 5) {c}_bp, round(avg(abs(d{c})) / avg(abs(dgap)), 5) {c}_share" for c in ("adr", "fx", "local")) + " FROM parts GROUP BY 1")
_add("agg06_variance_parts", lambda s, d: rounded(P.variance_parts(P.decomposition(panel(s, d)))),
     _PARTS + ", v AS (SELECT pair_id, var_samp(dgap) var_gap, var_samp(dadr) var_adr, var_samp(dfx) var_fx, var_samp(dlocal) var_local, covar_samp(dadr, dfx) cov_adr_fx, covar_samp(dadr, dlocal) cov_adr_local, covar_samp(dfx, dlocal) cov_fx_local FROM parts GROUP BY 1) SELECT pair_id, " + ", ".join(f"round({c}, 6) {c}" for c in ("var_gap", "var_adr", "var_fx", "var_local", "cov_adr_fx", "cov_adr_local", "cov_fx_local")) + ", round(abs(var_gap - (var_adr + var_fx + var_local + 2 * cov_adr_fx - 2 * cov_adr_local - 2 * cov_fx_local)), 6) residual FROM v")
QUERIES["agg06_variance_parts"] = lambda s, d: rounded(P.variance_parts(P.decomposition(panel(s, d))).withColumn("residual", F.abs("residual")))
_add("agg08_coverage", lambda s, d: rounded(P.coverage(daily_bars(s, d))),
     ", g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY pair_id, leg ORDER BY date), date) gap FROM bars) SELECT pair_id, leg, count(*) AS rows, min(date) first_date, max(date) last_date, max(gap) max_gap, CAST(count_if(close IS NULL) AS BIGINT) null_closes FROM g GROUP BY 1, 2")
_add("join09_calendar_cost", lambda s, d: P.calendar_cost(daily_bars(s, d)),
     ", f AS (SELECT pair_id, date, bool_or(leg = 'A') a, bool_or(leg = 'N') n FROM bars WHERE leg IN ('A', 'N') GROUP BY 1, 2), e AS (SELECT pair_id, greatest(min(date) FILTER (a), min(date) FILTER (n)) lo, least(max(date) FILTER (a), max(date) FILTER (n)) hi FROM f GROUP BY 1) SELECT pair_id, CAST(count_if(a AND n) AS BIGINT) AS both, CAST(count_if(a AND NOT n) AS BIGINT) adr_only, CAST(count_if(n AND NOT a) AS BIGINT) local_only FROM f JOIN e USING (pair_id) WHERE date BETWEEN lo AND hi GROUP BY 1")
_add("join10_event_window", lambda s, d: rounded(P.event_window(panel(s, d), "1998-06-15", 5, 10)),
     ", a AS (SELECT *, min(rn) FILTER (date >= DATE '1998-06-15') OVER (PARTITION BY pair_id) anchor FROM panel) SELECT pair_id, date, rn - anchor AS \"offset\", round(pi, 6) pi FROM a WHERE rn - anchor BETWEEN -5 AND 10")
_add("win02_realised_volatility", lambda s, d: rounded(S.realised_volatility(panel(s, d), 20).select("pair_id", "date", "vol")),
     ", c AS (SELECT pair_id, date, ln(adr) - lag(ln(adr)) OVER (PARTITION BY pair_id ORDER BY date) r FROM panel), k AS (SELECT * FROM c WHERE r IS NOT NULL) SELECT pair_id, date, round(CASE WHEN count(*) OVER w >= 20 THEN stddev_samp(r) OVER w * sqrt(252) END, 6) vol FROM k WINDOW w AS (PARTITION BY pair_id ORDER BY date ROWS 19 PRECEDING)")
_add("win03_drawdown", lambda s, d: rounded(S.drawdown(panel(s, d), 60).select("pair_id", "date", "drawdown")),
     " SELECT pair_id, date, round(CASE WHEN count(*) OVER w >= 60 THEN pi - max(pi) OVER w END, 6) drawdown FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date ROWS 59 PRECEDING)")
_add("win04_trend", lambda s, d: rounded(S.trend(panel(s, d), 20).select("pair_id", "date", "trend")), " SELECT pair_id, date, round(fx / lag(fx, 20) OVER (PARTITION BY pair_id ORDER BY date) - 1, 6) trend FROM panel")
_add("win05_dollar_volume", lambda s, d: rounded(R.dollar_volume(daily_bars(s, d), daily_fx(s, d))),
     """, u AS (
  SELECT pair_id, leg, date, close * volume / CASE WHEN leg = 'N' THEN last_value(fx IGNORE NULLS) OVER (PARTITION BY pair_id, leg ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 1 END AS usd
  FROM bars LEFT JOIN fx USING (date) WHERE leg IN ('A', 'N')),
a AS (SELECT *, CASE WHEN count(usd) OVER w >= 3 THEN avg(usd) OVER w END AS adv FROM u WINDOW w AS (PARTITION BY pair_id, leg ORDER BY date ROWS 19 PRECEDING))
SELECT pair_id, leg, date, round(adv, 6) AS adv FROM a WHERE adv IS NOT NULL""")
_add("win06_trailing_rank", lambda s, d: rounded(S.trailing_rank(panel(s, d), 250, 60).select("pair_id", "date", "rank", "state")),
     ", r AS (SELECT a.pair_id, a.date, count(*) k, (count_if(b.pi <= a.pi) - 1) / (count(*) - 1) AS rank FROM panel a JOIN panel b ON a.pair_id = b.pair_id AND b.rn BETWEEN a.rn - 249 AND a.rn GROUP BY 1, 2), q AS (SELECT pair_id, date, CASE WHEN k >= 60 THEN rank END AS rank FROM r) SELECT pair_id, date, round(rank, 6) AS rank, CASE WHEN rank <= 1.0 / 3 THEN 'low' WHEN rank <= 2.0 / 3 THEN 'normal' WHEN rank IS NOT NULL THEN 'tight' END state FROM q")
_add("win10_forward", lambda s, d: rounded(S.forward(panel(s, d), 20).select("pair_id", "date", "target", "log_change", "peak")),
     ", f AS (SELECT pair_id, date, lead(pi, 20) OVER w target, ln(1 + lead(pi, 20) OVER w) - ln(1 + pi) log_change, max(pi) OVER (PARTITION BY pair_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) peak FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date)) SELECT pair_id, date, round(target, 6) target, round(log_change, 6) log_change, round(peak, 6) peak FROM f WHERE target IS NOT NULL")
_add("win12_margin_path", lambda s, d: rounded(S.margin_path(panel(s, d), 1e6).select("pair_id", "date", "loss", "peak_call"), 2),
     ", m AS (SELECT pair_id, date, coalesce(pi - lag(pi) OVER (PARTITION BY pair_id ORDER BY date), 0) * 1e6 step FROM panel), l AS (SELECT pair_id, date, greatest(sum(step) OVER (PARTITION BY pair_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0) loss FROM m) SELECT pair_id, date, round(loss, 2) loss, round(max(loss) OVER (PARTITION BY pair_id ORDER BY date ROWS UNBOUNDED PRECEDING), 2) peak_call FROM l")
_FOLDS = ", b AS (SELECT pair_id, date, pi, rn - 1 AS i, count(*) OVER (PARTITION BY pair_id) n FROM panel), e AS (SELECT *, n // 6 AS least FROM b), f AS (SELECT *, least + floor((fold - 1) * (n - least) / 5.0) lo, least + floor(fold * (n - least) / 5.0) hi FROM e, (SELECT unnest([1, 2, 3, 4, 5]) fold)), folds AS (SELECT pair_id, date, pi, fold, CASE WHEN i >= lo AND i < hi THEN 'test' WHEN i < lo - 5 THEN 'train' WHEN i < lo THEN 'embargoed' END role FROM f WHERE i < hi)"
_add("win14_walk_forward", lambda s, d: S.fold_report(S.walk_forward(panel(s, d), 5, 5)).withColumn("fold", F.col("fold").cast("long")),
     _FOLDS + " SELECT pair_id, CAST(fold AS BIGINT) fold, " + ", ".join(f"CAST(count_if(role = '{r}') AS BIGINT) {r}" for r in ("train", "test", "embargoed")) + " FROM folds GROUP BY 1, 2")
_add("fit02_ridge_scores", lambda s, d: rounded(S.ridge_scores(S.walk_forward(panel(s, d), 5, 5), 5, 1e-4), 5),
     _FOLDS + ", y AS (SELECT *, pi x, lead(pi, 5) OVER (PARTITION BY pair_id, fold ORDER BY date) y FROM folds), t AS (SELECT pair_id, fold, avg(x) mx, avg(y) my, covar_pop(x, y) cxy, var_pop(x) cxx, count(*) m FROM y WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2), g AS (SELECT pair_id, x, y, my + (x - mx) * (cxy * m) / (cxx * m + 1e-4) guess FROM y JOIN t USING (pair_id, fold) WHERE role = 'test' AND y IS NOT NULL) SELECT pair_id, count(*) n, round(sqrt(avg((y - guess) ** 2)), 5) rmse, round(1 - sum((y - guess) ** 2) / (var_pop(y) * count(*)), 5) r2, round(avg(CASE WHEN y <> x THEN CAST(sign(guess - x) = sign(y - x) AS INT) END), 5) sign_hit FROM g GROUP BY 1")
_add("agg12_local_projection", lambda s, d: rounded(S.local_projection(panel(s, d), [1, 5, 20, 60])),
     ", x AS (SELECT pair_id, rn, pi - avg(pi) OVER (PARTITION BY pair_id) x FROM panel), j AS (SELECT a.pair_id, h, a.x, b.x y FROM x a, (SELECT unnest([1, 5, 20, 60]) h) k, x b WHERE a.pair_id = b.pair_id AND b.rn = a.rn + h) SELECT pair_id, CAST(h AS BIGINT) h, count(*) n, round(covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1e-4), 6) rho, round(corr(x, y) ** 2, 6) r2 FROM j GROUP BY 1, 2")
_add("win21_non_overlapping", lambda s, d: rounded(S.non_overlapping(panel(s, d), 20).groupBy("pair_id").agg(F.count("*").alias("n"), F.avg("pi").alias("mean_pi"))),
     " SELECT pair_id, count(*) n, round(avg(pi), 6) mean_pi FROM panel WHERE (rn - 1) % 20 = 0 GROUP BY 1")
_add("agg36_calm_and_stress", lambda s, d: rounded(S.calm_and_stress(panel(s, d))),
     ", m AS (SELECT pair_id, abs(pi - lag(pi) OVER (PARTITION BY pair_id ORDER BY date)) m FROM panel), k AS (SELECT pair_id, quantile_cont(m, 0.8) cut FROM m WHERE m IS NOT NULL GROUP BY 1) SELECT pair_id, m > cut stress, count(*) n, round(avg(m), 6) mean_move FROM m JOIN k USING (pair_id) WHERE m IS NOT NULL GROUP BY 1, 2")
_add("agg21_fx_regression", lambda s, d: rounded(S.fx_regression(panel(s, d))),
     ", r AS (SELECT pair_id, ln(fx) - lag(ln(fx)) OVER w x, pi - lag(pi) OVER w y FROM panel WINDOW w AS (PARTITION BY pair_id ORDER BY date)), k AS (SELECT * FROM r WHERE x IS NOT NULL), g AS (SELECT pair_id, count(*) n, regr_slope(y, x) beta, regr_r2(y, x) r2, regr_syy(y, x) syy, regr_sxy(y, x) sxy, regr_sxx(y, x) sxx FROM k GROUP BY 1) SELECT pair_id, n, round(beta, 6) beta, round(r2, 6) r2, round(sqrt((syy - beta * sxy) / (n - 2) / sxx), 6) se FROM g")

_ADDRESS, _HREF = r"https?://[^\s\"'<>)]+", r"(?i)href\s*=\s*[\"']?([^\s\"'<>)]+)"


def _urls(s, d):
    """TXT-04: different links of all pages: what href attributes point at and addresses in the text, closing punctuation cut off."""
    found = (F.regexp_extract_all("html", F.lit(p), F.lit(g)) for p, g in ((_HREF, 1), (_ADDRESS, 0)))
    hits = read(s, d, "pages").select(F.explode(F.concat(*found)).alias("u"))
    return hits.select(F.regexp_replace("u", "[.,;]+$", "").alias("link")).where("link <> ''").distinct()


_add("txt04_links", _urls, f"""
WITH u AS (SELECT unnest(list_concat(regexp_extract_all(html, '{_HREF.replace("'", "''")}', 1), regexp_extract_all(html, '{_ADDRESS.replace("'", "''")}'))) AS u FROM pages)
SELECT DISTINCT regexp_replace(u, '[.,;]+$', '') AS link FROM u WHERE regexp_replace(u, '[.,;]+$', '') <> ''""", raw=True)


def _lines(s, d):
    """TXT-01: lines that match labelled patterns, by label."""
    lines = read(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    labels = {"secret": "(?i)(password|token|api_?key)", "address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "licence": "(?i)licen[cs]e"}
    counts = lines.agg(*(F.count_if(F.col("line").rlike(p)).alias(k) for k, p in labels.items()))
    return counts.select(F.expr("stack(3, " + ", ".join(f"'{k}', {k}" for k in labels) + ") AS (label, n)"))


_add("txt01_line_scan", _lines, "WITH l AS (SELECT unnest(string_split(text, chr(10))) line FROM documents) " + " UNION ALL ".join(f"SELECT '{k}' AS label, CAST(count_if(regexp_matches(line, '{p}')) AS BIGINT) n FROM l" for k, p in {"secret": "(?i)(password|token|api_?key)", "address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "licence": "(?i)licen[cs]e"}.items()), raw=True)


def _digests(s, d):
    """SNK-02, first form: the least row hash of date and volume, which is no digest of the series; see snk02_whole_digest."""
    row = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), F.col("volume").cast("string"))
    return daily_bars(s, d).groupBy("pair_id", "leg").agg(F.count("*").alias("rows"), F.min(F.sha2(row, 256)).alias("least_digest"))


_add("snk02_series_digest", _digests, " SELECT pair_id, leg, count(*) AS rows, min(sha256(strftime(date, '%Y-%m-%d') || ',' || volume)) least_digest FROM bars GROUP BY 1, 2")


def series_digest(bars: DataFrame) -> DataFrame:
    """SNK-02: a digest of all rows and columns of each series in canonical form; a series is bounded by its calendar.

    A half of the sixth decimal is lifted before rounding, so that the last bit of a quotient doesn't decide.
    """
    numbers = [F.format_string("%.6f", F.round(F.col(c).cast("double") + 1e-9, 6)) for c in ("close", "high", "low", "volume")]
    row = F.sha2(F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *(F.coalesce(n, F.lit("")) for n in numbers)), 256)
    return bars.groupBy("pair_id", "leg").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"))


_add("snk02_whole_digest", lambda s, d: series_digest(daily_bars(s, d)),
     ", h AS (SELECT pair_id, leg, sha256(strftime(date, '%Y-%m-%d') || " + " || ".join(f"',' || coalesce(printf('%.6f', round(CAST({c} AS DOUBLE) + 1e-9, 6)), '')" for c in ("close", "high", "low", "volume")) + ") h FROM bars) SELECT pair_id, leg, count(*) AS rows, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM h GROUP BY 1, 2")


def _minutes(s, d):
    """STR-04: hourly bars of each feed."""
    e = read(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("symbol"))
    order = F.struct("ts", "event_id")
    return rounded(e.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")))


_add("str04_hour_bars", _minutes, "SELECT date_trunc('hour', ts) AS hour, event_type AS symbol, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) high, round(min(value), 6) low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) n FROM events GROUP BY 1, 2", raw=True)


def _holdings(s, d):
    """AGG-46: positions and value by manager and quarter."""
    items = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter"))
    rows = items.join(read(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("manager")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(rows.groupBy("manager", "quarter").agg(F.count_distinct("l_partkey").alias("positions"), F.sum("l_extendedprice").alias("value")), 2)


_add("agg46_filing_screen", _holdings, "SELECT o_custkey % 20 AS manager, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, count(DISTINCT l_partkey) positions, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2", raw=True)
