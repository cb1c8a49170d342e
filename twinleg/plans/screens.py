"""Queries of manager screens: managers are customers, issuers parts by name and brand, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import screens as C
from twinleg.plans.panel import rounded
from twinleg.session import cut_lineage, registry
from twinleg.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WATCH = ["Small Ring", "brand#21"]
LEGS = [("colours", "RED WIDGET"), ("colours", "BLUE WIDGET"), ("rings", "SMALL RING"), ("rings", "RED RING"), ("rings", "BLUE RING"), ("brands", "BRAND#1"), ("brands", "BRAND#2")]
NOISE = "4-NOT|NONE"
_ISSUER = "upper(p_name || ' ' || p_brand)"


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def _items(s, d):
    parts = read(s, d, "part").select("p_partkey", "p_brand")
    return read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice").join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))


def _issuers(s, d):
    """(issuer, name): an issuer is known by the least key of the parts of its name."""
    return cut_lineage(read(s, d, "part").groupBy(F.expr(_ISSUER).alias("name")).agg(F.min("p_partkey").alias("issuer")).where("name is not null"))


def _holdings(s, d, issuers):
    """(manager, quarter, issuer, value): the items of a customer's orders, a row for each issuer and quarter of shipping.

    Rows of numbers only are joined and dealt once, by manager and quarter, for the sums by issuer and those by quarter.
    """
    parts = read(s, d, "part").select("p_partkey", F.expr(_ISSUER).alias("name")).join(registry(issuers), "name", "left").select("p_partkey", "issuer")
    orders = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("manager"))
    items = read(s, d, "lineitem").select("l_orderkey", "l_partkey", F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter"), "l_extendedprice")
    rows = items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(registry(parts, 64), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("manager", "quarter", "issuer", "l_extendedprice").repartition("manager", "quarter").groupBy("manager", "quarter", "issuer").agg(F.sum("l_extendedprice").alias("value"))


def _watch(s):
    return s.createDataFrame([(w,) for w in WATCH], "needle string")


def _legs(s):
    return s.createDataFrame(LEGS, "family string, leg string")


def _families(s, d):
    issuers = _issuers(s, d)
    return C.families(_holdings(s, d, issuers), _legs(s), issuers)


def _books(s, d):
    issuers = _issuers(s, d)
    return C.watched_books(_holdings(s, d, issuers), _watch(s), issuers)


def _owners(s, d):
    return read(s, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("manager"), F.col("o_orderdate").cast("date").alias("filed_on"))


def _brokers(s, d):
    return C.common_brokers(read(s, d, "orders").select(F.col("o_custkey").alias("manager"), F.expr("' ' || lower(o_orderpriority)").alias("name")), NOISE)


def _fits(s, d):
    books = _books(s, d).select("manager", F.expr("watched_quarters / quarters").alias("score"), F.col("book").alias("capacity"))
    owners = _owners(s, d).select("manager", F.lit(True).alias("has_local")).distinct()
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("manager"), F.expr("c_mktsegment in ('MACHINERY', 'BUILDING')").alias("may_short"))
    return rounded(C.best_fits(rows.join(books.hint("merge"), "manager").join(owners.hint("merge"), "manager", "left")), 4)


def _screen(s, d):
    advisers = read(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("manager"), F.concat_ws(", ", "c_name", "c_mktsegment").alias("firm"))
    issuers = _issuers(s, d)
    books = C.books_with_families(_holdings(s, d, issuers), _watch(s), _legs(s), issuers)
    return rounded(C.manager_screen(read(s, d, "customer").select(F.col("c_custkey").alias("manager")), books, None, _owners(s, d), advisers, _brokers(s, d)), 2)


_HELD = """WITH held AS (SELECT o_custkey AS manager, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, upper(p_name || ' ' || p_brand) AS issuer, sum(l_extendedprice) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
_FAMILIES = _HELD + """, legs(family, leg) AS (VALUES ('colours', 'RED WIDGET'), ('colours', 'BLUE WIDGET'), ('rings', 'SMALL RING'), ('rings', 'RED RING'), ('rings', 'BLUE RING'), ('brands', 'BRAND#1'), ('brands', 'BRAND#2')),
bd AS (SELECT manager, quarter, count(*) AS breadth FROM held GROUP BY 1, 2),
fm AS (SELECT manager, quarter, family, string_agg(DISTINCT leg, ', ' ORDER BY leg) AS legs FROM held JOIN legs ON contains(issuer, leg) GROUP BY 1, 2, 3 HAVING count(DISTINCT leg) >= 2)"""
_BOOKS = _FAMILIES + """, qs AS (SELECT manager, quarter, count(*) AS positions, sum(value) AS book, sum(value) FILTER (contains(issuer, 'SMALL RING') OR contains(issuer, 'BRAND#21')) AS watched,
    bool_or(contains(issuer, 'SMALL RING')) AS ring, bool_or(contains(issuer, 'BRAND#21')) AS brand FROM held GROUP BY 1, 2),
bk AS (SELECT manager, max(quarter) AS newest, count(*) AS quarters, count(watched) AS watched_quarters, coalesce(arg_max(watched, quarter) FILTER (watched IS NOT NULL), 0) AS watched_value,
    concat_ws(', ', CASE WHEN bool_or(brand) THEN 'Brand#21' END, CASE WHEN bool_or(ring) THEN 'Small Ring' END) AS names, max(positions) AS breadth, max(book) AS book FROM qs GROUP BY 1)"""
_BROKERS = """bc AS (SELECT o_custkey AS manager, o_orderpriority AS name, count(*) AS times, count(*) OVER (PARTITION BY o_custkey) AS brokers FROM orders WHERE NOT starts_with(o_orderpriority, '4-NOT') GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY times DESC, name) AS rank FROM bc QUALIFY rank <= 3)"""
_add("agg47_families", lambda s, d: rounded(_families(s, d)), _FAMILIES + " SELECT manager, quarter, family, legs, breadth FROM fm JOIN bd USING (manager, quarter)")
_add("agg48_watched_books", lambda s, d: rounded(_books(s, d), 2),
     _BOOKS + " SELECT manager, newest, quarters, watched_quarters, round(watched_value, 2) AS watched_value, names, breadth, round(book, 2) AS book FROM bk")
_add("agg49_pull_manifest", lambda s, d: rounded(C.pull_manifest(_items(s, d).where("l_returnflag = 'R'").select(F.col("p_brand").alias("issuer"), F.col("l_shipdate").cast("date").alias("filed_on")), read(s, d, "part").select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit("x")))).alias("issuer")))),
     """WITH asked AS (SELECT DISTINCT unnest([p_brand, p_brand || 'x']) AS issuer FROM part), f AS (SELECT p_brand AS issuer, count(*) AS rows, min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1) SELECT issuer, coalesce(rows, 0) AS rows, first_date, last_date FROM asked LEFT JOIN f USING (issuer)""")
_add("top02_common_brokers", lambda s, d: rounded(_brokers(s, d)), f"WITH {_BROKERS} SELECT manager, upper(name) AS name, times, brokers, rank FROM br")
_add("top01_best_fits", _fits,
     _BOOKS + """, ow AS (SELECT DISTINCT o_custkey AS manager FROM orders WHERE o_totalprice > 480000),
mg AS (SELECT c_custkey AS manager, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN CASE WHEN ow.manager IS NOT NULL THEN 'full package' ELSE 'borrow + financing' END WHEN ow.manager IS NOT NULL THEN 'long-local financing' ELSE 'pass' END AS product,
    watched_quarters / quarters AS score, book AS capacity FROM customer JOIN bk ON bk.manager = c_custkey LEFT JOIN ow ON ow.manager = c_custkey),
tp AS (SELECT * FROM mg ORDER BY score DESC, capacity DESC, manager LIMIT 12)
SELECT manager, product, row_number() OVER (PARTITION BY product ORDER BY score DESC, capacity DESC, manager) AS place, round(score, 4) AS score, round(capacity, 4) AS capacity FROM tp""")
_add("join19_manager_screen", _screen,
     _BOOKS + f""", {_BROKERS}, ow AS (SELECT o_custkey AS manager, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS owner FROM orders WHERE o_totalprice > 480000 GROUP BY 1),
kn AS (SELECT manager, string_agg(DISTINCT family, ', ' ORDER BY family) AS families FROM fm GROUP BY 1), nm AS (SELECT manager, max(brokers) || ' named: ' || string_agg(name, ', ' ORDER BY rank) AS brokers FROM br GROUP BY 1)
SELECT c_custkey AS manager, CASE WHEN quarters IS NULL THEN 'no filing found' WHEN watched_quarters = 0 THEN 'none' ELSE names || ': ' || watched_quarters || '/' || quarters || ' quarters' END AS watched,
  round(watched_value, 2) AS watched_value, breadth, round(book, 2) AS book, CASE WHEN quarters IS NULL THEN 'no filing found' ELSE coalesce(families, 'none') END AS families, coalesce(owner, 'not in the ownership screen') AS owner,
  CASE WHEN c_custkey % 3 <> 0 THEN c_name || ', ' || c_mktsegment ELSE 'no adviser registration found' END AS adviser, coalesce(brokers, 'none named') AS brokers
FROM customer LEFT JOIN bk ON bk.manager = c_custkey LEFT JOIN kn ON kn.manager = c_custkey LEFT JOIN ow ON ow.manager = c_custkey LEFT JOIN nm ON nm.manager = c_custkey""")
