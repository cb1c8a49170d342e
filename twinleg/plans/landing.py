"""Queries that land payloads made of the bars and read them back, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleg.plans.panel import BASE
from twinleg.sources import landing as L
from twinleg.sources.tables import daily_bars

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_DAY = "2026-07-29"


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, f"WITH {BASE}{body}"


def payloads(s, d, pull: int = 1) -> DataFrame:
    """A month of a local leg as bytes, in a fixed form; the second pull lacks every January, revises every June, and its first
    pull lacked every November."""
    line = F.format_string("%s,%d", F.col("date").cast("string"), "volume")
    bars = daily_bars(s, d).where("leg = 'N'").withColumn("month", F.date_format("date", "yyyy-MM"))
    body = F.array_join(F.sort_array(F.collect_list(line)), "\n")
    months = bars.groupBy(F.col("pair_id").alias("source"), F.col("month").alias("series_id")).agg(body.alias("text"))
    number = F.month(F.concat("series_id", F.lit("-01")).cast("date"))
    months = months.where(number != (11 if pull == 1 else 1))
    text = F.when((number == 6) & (F.lit(pull) == 2), F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text"))
    return months.select("source", F.lit(_DAY).alias("partition"), "series_id", text.cast("binary").alias("body"))


_MONTHS = f""", m AS (
  SELECT pair_id AS source, strftime(date, '%Y-%m') AS series_id, month(date) AS k, string_agg(strftime(date, '%Y-%m-%d') || ',' || volume, chr(10) ORDER BY strftime(date, '%Y-%m-%d') || ',' || volume) AS body
  FROM bars WHERE leg = 'N' GROUP BY ALL),
landed AS (
  SELECT source, '{_DAY}' AS partition, series_id, sha256(body) AS sha256, 'first' AS pull FROM m WHERE k <> 11
  UNION ALL SELECT source, '{_DAY}', series_id, sha256(body), 'second' FROM m WHERE k = 11
  UNION ALL SELECT source, '{_DAY}.2', series_id, sha256(body || chr(10) || 'revised'), 'second' FROM m WHERE k = 6)"""


def _second_pull(s, d):
    root = L.workspace(s)
    L.land(payloads(s, d), root)
    return L.land(payloads(s, d, 2), root, revise=True).select("source", "partition", "series_id", "sha256", "status")


_add("snk01_immutable_write", _second_pull,
     _MONTHS + """
SELECT source, partition, series_id, sha256, CASE WHEN k = 11 THEN 'written' WHEN k = 6 THEN 'revised' ELSE 'unchanged' END AS status
FROM m JOIN landed USING (source, series_id) WHERE k <> 1 AND (k <> 6 OR pull = 'second')""")


def _verified(s, d):
    """SNK-04 after two pulls, with every March lost and every April damaged on disk."""
    root = L.workspace(s)
    L.land(payloads(s, d), root)
    L.land(payloads(s, d, 2), root, revise=True).count()
    L.damage(L.manifest(s, root).where("substring(series_id, 6, 2) in ('03', '04')"), root, "substring(series_id, 6, 2) = '03'")
    return L.verify(s, root).select("source", "partition", "series_id", "status")


_add("snk04_verify", _verified,
     _MONTHS + " SELECT source, partition, series_id, CASE substr(series_id, 6, 2) WHEN '03' THEN 'missing' WHEN '04' THEN 'MISMATCH' ELSE 'ok' END AS status FROM landed")


def _logged(s, d):
    """SNK-05: a line for each payload of two pulls, read back and counted."""
    root = L.workspace(s)
    for pull in (1, 2):
        done = L.land(payloads(s, d, pull), root, revise=True)
        lines = done.select(
            F.lit(f"2026-07-29T0{pull}:00:00Z").alias("pulled_at_utc"), "source", "series_id", F.lit("derived").alias("provider"), F.lit("table:lineitem").alias("source_url"),
            F.create_map(F.lit("pull"), F.lit(str(pull))).alias("params"), F.lit(1).cast("long").alias("rows"), F.col("series_id").alias("first_obs_date"), F.lit(None).cast("string").alias("last_obs_date"), "sha256", "path", "status",
        )
        L.append_log(lines, root)
    log = L.pull_log(s, root)
    return log.groupBy("source", F.col("params")["pull"].alias("pull"), "status").agg(F.count("*").alias("n"), F.min("first_obs_date").alias("first"), F.countDistinct("sha256").alias("digests"))


_add("snk05_pull_log", _logged,
     _MONTHS + """,
l AS (SELECT source, '1' AS pull, 'written' AS status, series_id, sha256(body) AS sha256 FROM m WHERE k <> 11
  UNION ALL SELECT source, '2', CASE WHEN k = 11 THEN 'written' WHEN k = 6 THEN 'revised' ELSE 'unchanged' END, series_id, sha256(CASE WHEN k = 6 THEN body || chr(10) || 'revised' ELSE body END) FROM m WHERE k <> 1)
SELECT source, pull, status, count(*) AS n, min(series_id) AS first, count(DISTINCT sha256) AS digests FROM l GROUP BY ALL""")
