"""Queries of the rule guards over rows in which violations are planted, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import folds as D
from twinleg.operators import guards as G
from twinleg.plans.folds import _folded
from twinleg.plans.panel import BASE, panel
from twinleg.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MARKETS = ["view", "click", "purchase", "signup"]


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def _events(s, d):
    """Stream events as a calendar: ids that repeat, days that don't exist, null titles, unknown references and open dates."""
    k = F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    rows = read(s, d, "events").where("event_id is not null and ts is not null").select(
        F.when(k % 97 == 96, k - 1).otherwise(k).cast("string").alias("id"),
        F.when(k % 89 == 5, "2023-02-30").when(k % 89 == 6, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(k % 50 == 7, "TODO(desk)").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("known_from"),
        F.when(k % 101 != 3, F.col("event_type")).alias("market"), text("user_id").alias("category"), F.when(k % 83 != 1, text("value")).alias("title"), text("value").alias("detail"), text("event_type").alias("source"),
        F.when(k % 10 == 0, F.array((k + 1).cast("string"), F.when(k % 70 == 0, F.concat(F.lit("x"), text("event_id"))))).alias("confounded_with"),
        F.when(k % 100 == 8, (k - 1).cast("string")).alias("supersedes"))
    return rows


_CALENDAR = """
calendar AS (
  SELECT CAST(CASE WHEN event_id % 97 = 96 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS id,
    CASE WHEN event_id % 89 = 5 THEN '2023-02-30' WHEN event_id % 89 = 6 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE WHEN event_id % 50 = 7 THEN 'TODO(desk)' ELSE strftime(ts, '%Y-%m-%d') END AS known_from, CASE WHEN event_id % 101 <> 3 THEN event_type END AS market,
    CAST(user_id AS VARCHAR) AS category, CASE WHEN event_id % 83 <> 1 THEN CAST(value AS VARCHAR) END AS title, CAST(value AS VARCHAR) AS detail, event_type AS source,
    CASE WHEN event_id % 10 = 0 THEN [CAST(event_id + 1 AS VARCHAR), CASE WHEN event_id % 70 = 0 THEN 'x' || event_id END] END AS confounded_with,
    CASE WHEN event_id % 100 = 8 THEN CAST(event_id - 1 AS VARCHAR) END AS supersedes
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL)"""
_BROKEN = f"""WITH {_CALENDAR},
absent AS (SELECT id, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in G.REQUIRED)}) AS detail FROM calendar),
refs AS (SELECT id, unnest(confounded_with) AS ref FROM calendar),
broken AS (
  SELECT 'missing' AS rule, coalesce(id, '(none)') AS key, detail FROM absent WHERE detail <> ''
  UNION ALL SELECT 'date', coalesce(id, '(none)'), date FROM calendar WHERE NOT (regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(date AS DATE) IS NOT NULL)
  UNION ALL SELECT 'market', coalesce(id, '(none)'), market FROM calendar WHERE market NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT 'duplicate', id, CAST(count(*) AS VARCHAR) FROM calendar WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'reference', coalesce(id, '(none)'), ref FROM refs WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM calendar WHERE id IS NOT NULL)
  UNION ALL SELECT 'unresolved', coalesce(id, '(none)'), known_from FROM calendar
    WHERE starts_with(known_from, 'TODO') AND (id IS NULL OR id NOT IN (SELECT supersedes FROM calendar WHERE supersedes IS NOT NULL)))"""
_add("set06_event_violations", lambda s, d: G.event_violations(_events(s, d), MARKETS), _BROKEN + " SELECT * FROM broken")


def _identities(s, d):
    """Filings of line items under the supplier's name; of those of every fifth supplier the seventh line has its neighbour's."""
    name = lambda c: F.concat(F.lit("Supplier#"), F.lpad((c).cast("string"), 9, "0"))
    k = F.col("l_suppkey")
    rows = read(s, d, "lineitem").select(k.alias("code"), F.when((F.col("l_linenumber") == 7) & (k % 5 == 0), name(k + 1)).otherwise(name(k)).alias("name"))
    return G.identity_violations(rows, read(s, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")))


_add("join18_identity", _identities, """WITH r AS (
  SELECT l_suppkey AS code, 'Supplier#' || lpad(CAST(CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS VARCHAR), 9, '0') AS name FROM lineitem)
SELECT 'identity' AS rule, CAST(code AS VARCHAR) AS key, s_name || ' / ' || name || ' x ' || count(*) AS detail FROM r JOIN supplier ON s_suppkey = code WHERE name <> s_name GROUP BY code, name, s_name""")


def _firewalls(s, d):
    """Closes become public at 20:00 of their session; decisions fall at 20:00 or, every third one, at 18:00 of the next day."""
    rows = panel(s, d)
    at = lambda hours: F.to_timestamp(F.col("date")) + F.expr(f"INTERVAL {hours} HOURS")
    features = rows.select("pair_id", at(20).alias("avail_ts"), F.when(F.dayofmonth("date") % 3 == 0, at(42)).otherwise(at(20)).alias("decision_ts"))
    return G.forward_test_violations(rows, ["Asia", "unlisted"]).unionByName(G.availability_violations(features))


_add("join21_firewalls", _firewalls, f"""WITH {BASE}
SELECT 'forward_test' AS rule, 'asia' AS key, CAST(count(*) AS VARCHAR) AS detail FROM panel WHERE pair_id = 'ASIA' HAVING count(*) > 0
UNION ALL SELECT 'availability', pair_id || '@' || strftime(date, '%Y-%m-%d') || ' 20:00:00', strftime(date, '%Y-%m-%d') || ' 20:00:00 x 1' FROM panel WHERE day(date) % 3 <> 0""")


def _scalers(s, d):
    """Training means and deviations of every fold; in the last fold of each series the whole sample's are planted."""
    frame = D.fold_frame(panel(s, d), [5, 20])
    keys = ["pair_id", "h"]
    stats = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")]
    whole = frame.dropDuplicates([*keys, "rn"]).groupBy(*keys).agg(*stats)
    fits = frame.where("role = 'train' and fold < 4").groupBy(*keys, "fold").agg(*stats).unionByName(whole.withColumn("fold", F.lit(4)))
    return G.scaler_violations(fits, whole, keys)


_add("fit04_scalers", _scalers, f"WITH {BASE}{_folded('level', False)}" + """,
entire AS (SELECT pair_id, h, avg(x) AS mean, stddev_samp(x) AS std FROM (SELECT DISTINCT pair_id, h, rn, x FROM frame) GROUP BY ALL),
fits AS (SELECT pair_id, h, fold, avg(x) AS mean, stddev_samp(x) AS std FROM frame WHERE role = 'train' AND fold < 4 GROUP BY ALL UNION ALL SELECT pair_id, h, 4, mean, std FROM entire),
near AS (SELECT f.*, abs(f.mean - w.mean) <= 1e-8 + 1e-9 * abs(w.mean) AS m, abs(f.std - w.std) <= 1e-8 + 1e-9 * abs(w.std) AS s FROM fits f JOIN entire w USING (pair_id, h))
SELECT 'scaler' AS rule, pair_id || '/' || h || '/' || fold AS key, concat_ws(',', CASE WHEN m THEN 'mean' END, CASE WHEN s THEN 'std' END) AS detail FROM near WHERE m OR s""")
