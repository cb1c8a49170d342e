"""Queries of provenance, quote checks and pooled scores, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import records as R
from twinleg.operators import series as S
from twinleg.plans.panel import _FOLDS, BASE, panel, rounded
from twinleg.sources.tables import daily_bars, daily_fx, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, body: str, raw: bool = False) -> None:
    QUERIES[name], ORACLES[name] = query, body if raw else f"WITH {BASE}{body}"


def _pulls(s, d):
    """Each order is a landed file: its source and customer, in a partition of its month numbered by the day."""
    day = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    name = F.when(F.dayofmonth("o_orderdate") == 1, day).otherwise(F.concat_ws(".", day, F.dayofmonth("o_orderdate").cast("string")))
    return read(s, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("file"), name.alias("partition"))


_add("src02_newest_pull", lambda s, d: rounded(R.newest_pull(_pulls(s, d), ["source", "file"])),
     "SELECT o_orderpriority AS source, o_custkey AS file, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || CASE WHEN day(o_orderdate) = 1 THEN '' ELSE '.' || day(o_orderdate) END AS partition, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(CASE WHEN day(o_orderdate) = 1 THEN 0 ELSE day(o_orderdate) END AS BIGINT) seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY date_trunc('month', o_orderdate) DESC, CASE WHEN day(o_orderdate) = 1 THEN 0 ELSE day(o_orderdate) END DESC) = 1", raw=True)
_TEXT = "case when o_orderstatus = 'P' then '--' when o_orderstatus = 'F' then concat('$ ', cast(cast(o_totalprice as decimal(18, 2)) as string)) else concat(cast(cast(o_totalprice as decimal(18, 2)) as string), '%') end"
_add("src05_clean_numbers", lambda s, d: rounded(read(s, d, "orders").select("o_orderstatus", R.clean_number(F.expr(_TEXT)).alias("v")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("v").alias("parsed"), F.sum("v").alias("total")), 2),
     "SELECT o_orderstatus, count(*) n, count(*) FILTER (o_orderstatus <> 'P') parsed, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE) FILTER (o_orderstatus <> 'P'), 2) total FROM orders GROUP BY 1", raw=True)


def _manifests(s, d):
    """Digests of each series by year: those before 1997 against those since 1996, whose volumes of 1996 are counted in pieces."""
    rows = daily_bars(s, d).withColumn("year", F.year("date")).groupBy("pair_id", "leg", "year").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    path = F.concat_ws("/", "pair_id", "leg", F.col("year").cast("string")).alias("path")
    old = rows.where("year < 1997").select(path, F.sha2(F.col("v").cast("string"), 256).alias("sha256"))
    new = rows.where("year >= 1995").select(path, F.sha2(F.when(F.col("year") == 1996, F.col("n")).otherwise(F.col("v")).cast("string"), 256).alias("sha256"))
    return R.merge_manifest(old, new, allow_update=True)


_add("snk03_manifest_merge", _manifests,
     ", r AS (SELECT pair_id || '/' || leg || '/' || year(date) AS path, year(date) y, count(*) n, CAST(sum(volume) AS BIGINT) v FROM bars GROUP BY 1, 2) SELECT path, sha256(CAST(CASE WHEN y = 1996 THEN n ELSE v END AS VARCHAR)) AS sha256, CASE WHEN y < 1995 THEN 'kept' WHEN y >= 1997 THEN 'new' WHEN y = 1996 AND n <> v THEN 'updated' ELSE 'same' END status, CASE WHEN y = 1996 AND n <> v THEN sha256(CAST(v AS VARCHAR)) END superseded FROM r")
_add("snk08_revisions", lambda s, d: rounded(R.revisions(daily_bars(s, d).where("leg = 'N'"), daily_bars(s, d).where("leg = 'R'"), ["pair_id", "date"], ["volume"]).groupBy("pair_id", "kind").agg(F.count("*").alias("n"))),
     ", a AS (SELECT pair_id, date, volume v FROM bars WHERE leg = 'N'), b AS (SELECT pair_id, date, volume w FROM bars WHERE leg = 'R') SELECT pair_id, CASE WHEN v IS NULL THEN 'added' WHEN w IS NULL THEN 'removed' ELSE 'changed' END kind, count(*) n FROM a FULL JOIN b USING (pair_id, date) WHERE v IS DISTINCT FROM w GROUP BY 1, 2")
_add("prj03_quote_direction", lambda s, d: rounded(R.quote_direction(daily_fx(s, d).withColumn("fx", F.when(F.dayofmonth("date") == 1, 1 / F.col("fx")).otherwise(F.col("fx"))), 120000.0, 180000.0).groupBy("direction").agg(F.count("*").alias("n"))),
     " SELECT CASE WHEN day(date) = 1 AND 1 / (1 / fx) BETWEEN 120000 AND 180000 THEN 'inverted' WHEN day(date) <> 1 AND fx BETWEEN 120000 AND 180000 THEN 'ok' ELSE 'out' END direction, count(*) n FROM fx GROUP BY 1")
_add("agg18_pooled_scores", lambda s, d: rounded(R.pooled_scores(S.ridge_predictions(S.walk_forward(panel(s, d), 5, 5), 5, 1e-4), "pair_id"), 5),
     _FOLDS + ", y AS (SELECT *, pi x, lead(pi, 5) OVER (PARTITION BY pair_id, fold ORDER BY date) y FROM folds), t AS (SELECT pair_id, fold, regr_slope(y, x) * regr_sxx(y, x) / (regr_sxx(y, x) + 1e-4) k, avg(x) mx, avg(y) my FROM y WHERE role = 'train' AND y IS NOT NULL GROUP BY 1, 2), g AS (SELECT pair_id, x, y, my + (x - mx) * k guess FROM y JOIN t USING (pair_id, fold) WHERE role = 'test' AND y IS NOT NULL) SELECT coalesce(pair_id, 'pooled') pair_id, pair_id IS NULL pooled, count(*) n, round(sqrt(avg((y - guess) ** 2)), 5) rmse, round(1 - sum((y - guess) ** 2) / (var_pop(y) * count(*)), 5) r2, round(avg((sign(guess - x) = sign(y - x))::INT) FILTER (y <> x), 5) sign_hit FROM g GROUP BY GROUPING SETS ((pair_id), ())")
