"""Queries that parse payloads derived from the tables, damaged in known ways; the oracle SQL gives the rows they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleg.plans.panel import BASE, rounded
from twinleg.sources import payloads as Y
from twinleg.sources.tables import daily_bars, daily_fx, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ZONES = {"ASIA": "Asia/Seoul", "EUROPE": "Europe/Berlin", "AFRICA": "Africa/Cairo", "AMERICA": "America/New_York", "MIDDLE EAST": "Asia/Dubai"}
_MONTH = "concat_ws('|', pair_id, date_format(date, 'yyyy-MM'))"


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def _cut(body: str, where: str) -> str:
    """The body, without its second half where a condition holds."""
    return f"if({where}, substring({body}, 1, int(length({body}) / 2)), {body}) AS body"


def _local(s, d) -> DataFrame:
    return daily_bars(s, d).where("leg = 'N'")


def _republic(s, d):
    date = "if(day(date) = 13, 'n/a', concat_ws('/', lpad(year(date) - 1911, 3, '0'), date_format(date, 'MM/dd')))"
    row = f"array({date}, format_string('%,d', volume), '0', string(high), string(high), string(low), if(day(date) = 7, '--', string(close)), '0')"
    months = _local(s, d).groupBy(F.expr(_MONTH).alias("source"), F.month("date").alias("month")).agg(F.expr(f"collect_list({row})").alias("data"))
    months = months.withColumn("json", F.expr("to_json(named_struct('stat', if(month = 2, 'NO DATA', 'OK'), 'data', data))"))
    return rounded(Y.republic_months(months.selectExpr("source", _cut("json", "month = 4"))))


_WHOLE = "month(date) NOT IN (2, 4) AND day(date) <> 13"
_add("src07_republic_months", _republic, f"""WITH {BASE},
b AS (SELECT pair_id || '|' || strftime(date, '%Y-%m') AS source, * FROM bars WHERE leg = 'N')
SELECT source, date, round(high, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, CASE WHEN day(date) <> 7 THEN round(close, 6) END AS close, CAST(volume AS DOUBLE) AS volume, NULL AS fault FROM b WHERE {_WHOLE}
UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, NULL, 'date' FROM b WHERE day(date) = 13 AND month(date) NOT IN (2, 4)
UNION ALL SELECT DISTINCT source, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, CASE month(date) WHEN 2 THEN 'status' ELSE 'malformed' END FROM b WHERE month(date) IN (2, 4)""")


def _rates(s, d):
    day = "named_struct('k', string(date), 'v', map(if(day(date) = 9, 'JPY', 'KRW'), fx))"
    months = daily_fx(s, d).groupBy(F.date_format("date", "yyyy-MM").alias("source"), F.month("date").alias("month")).agg(F.expr(f"map_from_entries(collect_list({day}))").alias("rates"))
    months = months.withColumn("json", F.expr("if(month = 3, '{\"base\": \"USD\", \"rates\": {}}', to_json(named_struct('base', 'USD', 'rates', rates)))"))
    return rounded(Y.rate_maps(months.selectExpr("source", _cut("json", "month = 4")), "KRW"))


_add("src08_rate_maps", _rates, f"""WITH {BASE},
f AS (SELECT strftime(date, '%Y-%m') AS source, date, fx FROM fx)
SELECT source, date, CASE WHEN day(date) <> 9 THEN round(fx, 6) END AS close, NULL AS fault FROM f WHERE month(date) NOT IN (3, 4)
UNION ALL SELECT DISTINCT source, NULL::DATE, NULL::DOUBLE, CASE month(date) WHEN 3 THEN 'empty' ELSE 'malformed' END FROM f WHERE month(date) IN (3, 4)""")


def _charts(s, d):
    zone = F.element_at(F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv)), F.col("pair_id"))
    rows = _local(s, d).withColumn("zone", zone).withColumn("copy", F.explode(F.expr("if(day(date) = 11, array(0, 1), array(1))")))
    opens = "timestampadd(HOUR, 9, cast(date as timestamp_ntz))"
    rows = rows.withColumn("epoch", F.expr(f"timestampdiff(SECOND, {Y.EPOCH}, convert_timezone(zone, 'UTC', {opens}))"))
    price = lambda c: f"if(day(date) = 10, null, {c} * if(copy = 0, 2, 1))"
    bar = f"struct(date, copy, epoch, {price('high')} AS high, {price('low')} AS low, {price('close')} AS close, double(volume) AS volume)"
    years = rows.groupBy("pair_id", "zone", F.year("date").alias("year")).agg(F.expr(f"array_sort(collect_list({bar}))").alias("b"))
    quote = "array(named_struct('open', b.high, 'high', b.high, 'low', b.low, 'close', b.close, 'volume', b.volume))"
    adjusted = "if(year % 2 = 0, null, array(named_struct('adjclose', transform(b.close, c -> c * 0.918273645D))))"
    stamps = "if(year = 1997, array(), b.epoch)"
    result = f"named_struct('meta', named_struct('exchangeTimezoneName', zone), 'timestamp', {stamps}, 'indicators', named_struct('quote', {quote}, 'adjclose', {adjusted}))"
    years = years.selectExpr("concat_ws('|', pair_id, year) AS source", "pair_id", "year", f"to_json(named_struct('chart', named_struct('result', if(year = 1999, array(), array({result})))), map('ignoreNullFields', 'false')) AS json")
    return rounded(Y.charts(years.selectExpr("source", _cut("json", "year = 1998 and pair_id like 'A%'"))))


_add("src11_charts", _charts, f"""WITH {BASE},
b AS (SELECT pair_id || '|' || year(date) AS source, *, year(date) = 1998 AND pair_id LIKE 'A%' AS cut FROM bars WHERE leg = 'N')
SELECT source, date, round(high, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(CASE WHEN year(date) % 2 = 0 THEN close ELSE close * 0.918273645::DOUBLE END, 6) AS adj_close,
  CAST(volume AS DOUBLE) AS volume, NULL AS fault FROM b WHERE NOT cut AND day(date) <> 10 AND year(date) NOT IN (1997, 1999)
UNION ALL SELECT DISTINCT source, NULL::DATE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, CASE WHEN cut THEN 'malformed' ELSE 'empty' END FROM b WHERE cut OR year(date) = 1999""")


def _lending(s, d):
    field = lambda k, v: f"'\"{k}\": ', {v}"
    day = "if(day(date) = 21, '19991345', date_format(date, 'yyyyMMdd'))"
    row = f"concat('{{\"TMPV1\": \"', {day}, '\", \"TMPV2\": \"', pair_id, '\", ', {field('TMPV3', 'volume')}, ', ', {field('TMPV4', 'if(day(date) = 5, \'######\', string(volume div 2))')}, ', ', {field('TMPV5', 'volume * 3')}, ', ', {field('TMPV6', 'if(day(date) = 6, \'12###\', string(volume * 7))')}, '}}')"
    totals = ", ".join(f'{{"TMPV1": "{name}", "TMPV3": 5}}' for name in Y.AGGREGATE_ROWS)
    months = _local(s, d).groupBy(F.expr(_MONTH).alias("source"), F.month("date").alias("month")).agg(F.expr(f"concat_ws(', ', collect_list({row}))").alias("rows"))
    months = months.withColumn("json", F.concat(F.lit('{"ds1": ['), "rows", F.lit(f", {totals}]}}")))
    return Y.lending_tables(months.selectExpr("source", _cut("json", "month = 4")))


_add("src12_lending_tables", _lending, f"""WITH {BASE},
b AS (SELECT pair_id || '|' || strftime(date, '%Y-%m') AS source, * FROM bars WHERE leg = 'N')
SELECT source, CASE WHEN day(date) <> 21 THEN date END AS date, pair_id AS issue_name, volume AS new_lending_shares, CASE WHEN day(date) <> 5 THEN volume // 2 END AS repaid_shares, volume * 3 AS balance_shares,
  CASE WHEN day(date) <> 6 THEN volume * 7 END AS balance_value_unverified_unit, CASE WHEN day(date) = 21 THEN 'date' END AS fault FROM b WHERE month(date) <> 4
UNION ALL SELECT DISTINCT source, NULL::DATE, NULL, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 'malformed' FROM b WHERE month(date) = 4""")


def _observations(s, d):
    row = "named_struct('date', string(date), 'value', if(day(date) = 3, '.', string(fx)))"
    months = daily_fx(s, d).groupBy(F.date_format("date", "yyyy-MM").alias("source"), F.month("date").alias("month")).agg(F.expr(f"to_json(named_struct('observations', if(month(first(date)) = 3, array(), collect_list({row}))))").alias("json"))
    return rounded(Y.observations(months.selectExpr("source", _cut("json", "month = 4"))))


_add("src09_observations", _observations, f"""WITH {BASE},
f AS (SELECT strftime(date, '%Y-%m') AS source, date, fx FROM fx)
SELECT source, date, round(fx, 6) AS close, NULL AS fault FROM f WHERE month(date) NOT IN (3, 4) AND day(date) <> 3
UNION ALL SELECT DISTINCT source, NULL::DATE, NULL::DOUBLE, CASE month(date) WHEN 3 THEN 'empty' ELSE 'malformed' END FROM f WHERE month(date) IN (3, 4)""")


def filing_documents(s, d):
    """(source, body, declared): an information table per supplier and year; every tenth lacks its end, every tenth claims one more."""
    tag = lambda k, v: f"'<{{n}}{k}>', {v}, '</{{n}}{k}>'"
    holding = f"concat('<{{n}}infoTable>', {tag('nameOfIssuer', '\' Part &amp; Co \', l_partkey')}, {tag('cusip', 'l_partkey')}, {tag('value', 'format_string(\'%,d\', bigint(l_extendedprice))')}, '<{{n}}shrsOrPrnAmt>', {tag('sshPrnamt', 'bigint(l_quantity)')}, '</{{n}}shrsOrPrnAmt></{{n}}infoTable>')"
    docs = read(s, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.expr(f"concat_ws('', collect_list({holding}))").alias("rows"), F.count("*").alias("n"))
    docs = docs.withColumn("xml", F.expr("concat('<{n}informationTable xmlns', if(year % 2 = 0, ':n1', ''), '=\"http://example.org/filings\">', rows, '</{n}informationTable>')"))
    docs = docs.withColumn("xml", F.expr("replace(xml, '{n}', if(year % 2 = 0, 'n1:', ''))"))
    body = "if(l_suppkey % 10 = 3, substring(xml, 1, length(xml) - 30), xml) AS body"
    return docs.selectExpr("concat_ws('|', l_suppkey, year) AS source", body, "n + int(l_suppkey % 10 = 4) AS declared")


_add("src14_information_tables", lambda s, d: Y.information_tables(filing_documents(s, d)), """
WITH l AS (SELECT l_suppkey || '|' || year(l_shipdate) AS source, * FROM lineitem)
SELECT source, 'PART & CO ' || l_partkey AS issuer, CAST(l_partkey AS VARCHAR) AS cusip, trunc(l_extendedprice)::DOUBLE AS value, trunc(l_quantity)::DOUBLE AS shares, NULL AS fault FROM l WHERE l_suppkey % 10 NOT IN (3, 4)
UNION ALL SELECT DISTINCT source, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE, CASE l_suppkey % 10 WHEN 3 THEN 'malformed' ELSE 'count' END FROM l WHERE l_suppkey % 10 IN (3, 4)""")


def _registry(s, d):
    code = "if(s_suppkey % 3 = 0, '  ', lpad(s_suppkey, 6, '0'))"
    entry = f"concat('<list><corp_code>', s_suppkey * 7, '</corp_code><corp_name> ', s_name, ' &lt;', s_suppkey, '&gt; </corp_name><stock_code>', {code}, '</stock_code></list>')"
    docs = read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("source")).agg(F.expr(f"concat('<result>', concat_ws('', collect_list({entry})), '</result>')").alias("xml"))
    return Y.registry_codes(docs.selectExpr("string(source) AS source", _cut("xml", "source = 7")))


_add("src17_registry_codes", _registry, """
SELECT CAST(s_nationkey AS VARCHAR) AS source, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, CAST(s_suppkey * 7 AS VARCHAR) AS corp_code, s_name || ' <' || s_suppkey || '>' AS corp_name, NULL AS fault
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey <> 7
UNION ALL SELECT DISTINCT '7', NULL, NULL, NULL, 'malformed' FROM supplier WHERE s_nationkey = 7""")
