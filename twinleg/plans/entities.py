"""Queries of entity resolution over names derived from suppliers and customers, each beside its oracle SQL (which compares all pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import entities as E
from twinleg.plans.panel import rounded
from twinleg.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The name of a filing entity, and what customers ask for: the nation's house by number, or the number alone.
_NAME = "n_name || ' Capital ' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN ' Fund, L.P.' WHEN 1 THEN ' TRUST' WHEN 2 THEN ', Inc.' ELSE ' Management' END"
_ASK = "CASE c_custkey % 3 WHEN 0 THEN 'Capital ' || c_custkey % 90 WHEN 1 THEN n_name || ' capital, ' || c_custkey % 40 ELSE n_name || ' House ' || c_custkey % 5 END"
BASE = f"""
WITH names AS (SELECT s_suppkey AS id, upper({_NAME}) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey),
needles AS (SELECT DISTINCT {_ASK} AS needle FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT *, translate(upper(name), '.,', '') AS nn FROM names), k AS (SELECT *, translate(upper(needle), '.,', '') AS nk FROM needles)"""
_RANKED = BASE + """,
hits AS (SELECT needle, id, name, starts_with(nn, nk) AS prefix, regexp_matches(name, 'FUND|TRUST|PORTFOLIO|ETF|INDEX|SERIES') AS vehicle FROM k JOIN n ON contains(nn, nk)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY NOT prefix, vehicle, length(name), name, id) AS rank FROM hits QUALIFY rank <= 25)"""
_FILED = _RANKED + """,
filings AS (SELECT l_suppkey AS id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS report_date, count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'N') AS holdings FROM lineitem GROUP BY ALL),
recent AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY report_date DESC) AS k FROM filings QUALIFY k <= 8),
able AS (SELECT id, count(*) AS filings, max(report_date) AS newest, arg_max(holdings, report_date) AS held FROM recent WHERE report_date >= DATE '2000-01-01' GROUP BY 1 HAVING held > 0)"""


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def names(s, d):
    rows = read(s, d, "supplier").join(F.broadcast(read(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("id"), F.expr(f"upper({_NAME})").alias("name"), F.expr("if(s_suppkey % 3 = 0, 'INACTIVE', 'ACTIVE')").alias("status"))


def needles(s, d):
    rows = read(s, d, "customer").join(F.broadcast(read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.expr(_ASK).alias("needle")).distinct()


def filings(s, d):
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date").alias("report_date")
    return read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), quarter).agg(F.expr("count_if(l_linestatus = 'O' and l_returnflag <> 'N')").alias("holdings"))


def _ranked(s, d):
    return E.candidates(names(s, d).drop("status"), needles(s, d))


_add("join14_candidates", lambda s, d: rounded(_ranked(s, d)), _RANKED + " SELECT needle, CAST(id AS BIGINT) AS id, name, prefix, vehicle, rank FROM ranked")
_add("join15_by_capability", lambda s, d: rounded(E.by_capability(_ranked(s, d), filings(s, d), "2000-01-01")),
     _FILED + " SELECT needle, CAST(id AS BIGINT) AS id, name, rank, filings, newest FROM ranked JOIN able USING (id) QUALIFY row_number() OVER (PARTITION BY needle ORDER BY rank) = 1")
_add("join16_registration", lambda s, d: rounded(E.registration(names(s, d), needles(s, d))),
     BASE + """,
hits AS (SELECT k.*, n.* FROM k JOIN n ON contains(nn, string_split(nk, ' ')[1])),
best AS (SELECT *, starts_with(nn, array_to_string(string_split(nk, ' ')[1:2], ' ')) AS good FROM hits QUALIFY row_number() OVER (PARTITION BY needle ORDER BY status <> 'ACTIVE', NOT starts_with(nn, nk), length(nn), name, id) = 1)
SELECT needle, CASE WHEN good THEN CAST(id AS BIGINT) END AS id, CASE WHEN good THEN name END AS name, CASE WHEN good THEN status END AS status, NOT good AS refused FROM best""")


def _watched(s, d):
    held = read(s, d, "lineitem").join(names(s, d).select("id", F.col("name").alias("issuer")).hint("merge"), F.col("l_suppkey") == F.col("id"))
    held = held.groupBy("issuer").agg(F.count("*").alias("rows"), F.sum("l_extendedprice").alias("value"))
    return rounded(E.watched(held, needles(s, d).where("needle like 'Capital%'")).withColumn("watched", F.array_join("watched", "|")), 2)


_add("join17_watch_list", _watched,
     BASE + """,
held AS (SELECT name AS issuer, nn, count(*) AS rows, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN n ON l_suppkey = id GROUP BY ALL)
SELECT issuer, rows, value, string_agg(needle, '|' ORDER BY needle) AS watched FROM held JOIN k ON contains(nn, nk) AND needle LIKE 'Capital%' GROUP BY ALL""")
