"""Payload parsers on hand-made bodies: masked numbers, calendars, zones, missing parts, broken bodies, name spaces, declared totals."""

import datetime
import json

from twinleg.sources import payloads as Y

day = datetime.date


def bodies(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source string, body string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_numbers(spark):
    df = spark.createDataFrame([("1,234.5",), ("$7",), ("3%",), ("--",), ("",), (" - ",), ("N/A",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(Y.number(df.t)).collect()] == [1234.5, 7.0, 3.0] + [None] * 6


def test_republic_months(spark):
    body = json.dumps({"stat": "OK", "data": [["113/02/29", "1,000", "9", "10.5", "11", "9", "--", "0"], ["112/02/29", "1", "9", "1", "1", "1", "1", "0"], ["x"], []]})
    got = Y.republic_months(bodies(spark, body, '{"stat": "NO"}', body[:60], None, "", "[1]"))
    assert rows(Y.good(got), "source", "date", "open", "close", "volume") == [("s0", day(2024, 2, 29), 10.5, None, 1000.0)]
    assert rows(Y.quarantine(got), "source", "fault", "n") == [("s0", "date", 3), ("s1", "status", 1), ("s2", "malformed", 1), ("s3", "malformed", 1), ("s4", "malformed", 1), ("s5", "malformed", 1)]


def test_rate_maps(spark):
    got = Y.rate_maps(bodies(spark, '{"rates": {"2024-01-02": {"KRW": 1300.5, "JPY": 1}, "2024-01-03": {"JPY": 2}, "oops": {"KRW": 1}}}', '{"rates": {}}', "{}", '{"rates'), "KRW")
    assert rows(got, "source", "date", "close", "fault") == sorted([("s0", day(2024, 1, 2), 1300.5, None), ("s0", day(2024, 1, 3), None, None), ("s0", None, None, "date"), ("s1", None, None, "empty"), ("s2", None, None, "empty"), ("s3", None, None, "malformed")], key=str)


def test_charts_take_the_exchange_date(spark):
    chart = lambda zone, stamps, closes, adjusted=None: json.dumps({"chart": {"result": [{"meta": {"exchangeTimezoneName": zone}, "timestamp": stamps, "indicators": {"quote": [{"close": closes, "volume": [1] * len(closes)}], **({"adjclose": [{"adjclose": adjusted}]} if adjusted else {})}}]}})
    seoul = 1704153600 - 86400  # 2024-01-02 09:00 in Seoul is 2024-01-02 00:00 UTC
    got = Y.charts(bodies(spark, chart("Asia/Seoul", [seoul + 86400, seoul + 86400 + 60, seoul + 2 * 86400], [5.0, 6.0, None]), chart("America/New_York", [1704205800], [7.0], [3.5]), '{"chart": {"result": []}}', chart("UTC", [], []), "{"))
    assert rows(got, "source", "date", "close", "adj_close", "fault") == sorted([("s0", day(2024, 1, 2), 6.0, 6.0, None), ("s1", day(2024, 1, 2), 7.0, 3.5, None), ("s2", None, None, None, "empty"), ("s4", None, None, None, "malformed")], key=str)
    late = chart("Asia/Seoul", [1704124800], [1.0])  # 2024-01-01 16:00 UTC is already the 2nd in Seoul
    assert rows(Y.charts(bodies(spark, late)), "date") == [(day(2024, 1, 2),)]


def test_masked_lending_json(spark):
    body = '{"ds1": [{"TMPV1": "20260729", "TMPV2": "x", "TMPV3": 12, "TMPV4": ######, "TMPV5": 14348212, "TMPV6": 20####}, {"TMPV1": "20260728", "TMPV3":1}, {"TMPV1": "합계", "TMPV3": ####}, {"TMPV1": "평균"}, {"TMPV1": "2026"}]}'
    got = Y.lending_tables(bodies(spark, body, body[:80]))
    assert rows(Y.good(got), "date", "repaid_shares", "balance_shares", "balance_value_unverified_unit") == [(day(2026, 7, 28), None, None, None), (day(2026, 7, 29), None, 14348212, None)]
    assert rows(Y.quarantine(got), "source", "fault", "n") == [("s0", "date", 1), ("s1", "malformed", 1)]


def test_observations(spark):
    got = Y.observations(bodies(spark, '{"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "4.25"}]}', "{}"))
    assert rows(got, "source", "date", "close", "fault") == [("s0", day(2024, 1, 2), 4.25, None), ("s1", None, None, "empty")]


TABLE = '<{n}informationTable xmlns{m}="http://x.org"><{n}infoTable><{n}nameOfIssuer> Sk &amp; Hynix </{n}nameOfIssuer><{n}cusip>78</{n}cusip><{n}value>1,234</{n}value><{n}shrsOrPrnAmt><{n}sshPrnamt>5</{n}sshPrnamt></{n}shrsOrPrnAmt></{n}infoTable><{n}infoTable><{n}cusip>79</{n}cusip><{n}value>many</{n}value></{n}infoTable></{n}informationTable>'


def test_information_tables(spark, tmp_path):
    plain, spaced = TABLE.format(n="", m=""), TABLE.format(n="n1:", m=":n1")
    one = plain.replace(plain[plain.rindex("<infoTable>"):plain.rindex("</informationTable>")], "")
    df = spark.createDataFrame([("a", plain, 2), ("b", spaced, 2), ("c", plain, 3), ("d", plain[:-9], 2), ("e", None, 0), ("f", one, 1), ("g", '<informationTable xmlns="http://x.org"></informationTable>', 4)], "source string, body string, declared int")
    got = Y.information_tables(df)
    both = [("SK & HYNIX", "78", 1234.0, 5.0), ("", "79", 0.0, 0.0)]
    assert rows(Y.good(got), "source", "issuer", "cusip", "value", "shares") == sorted([(s, *h) for s in "ab" for h in both] + [("f", *both[0])], key=str)
    assert rows(Y.quarantine(got), "source", "fault", "n") == [("c", "count", 1), ("d", "malformed", 1), ("e", "malformed", 1), ("g", "count", 1)]
    (tmp_path / "t.xml").write_text(spaced)
    assert rows(Y.information_files(spark, str(tmp_path)), "issuer", "cusip", "value", "shares") == sorted(both, key=str)


def test_registry_codes(spark):
    entry = lambda c, n, s: f"<list><corp_code>{c}</corp_code><corp_name>{n}</corp_name><stock_code>{s}</stock_code></list>"
    body = f"<result>{entry('001', 'A', '000660')}{entry('002', 'B', ' ')}{entry('003', ' C ', '005930')}{entry('004', 'A2', '000660')}</result>"
    got = Y.registry_codes(bodies(spark, body, body[:-20], f"<result>{entry('9', 'one', '1')}</result>"))
    assert rows(got, "source", "stock_code", "corp_code", "corp_name", "fault") == sorted([("s0", "000660", "004", "A2", None), ("s0", "005930", "003", "C", None), ("s1", None, None, None, "malformed"), ("s2", "1", "9", "one", None)], key=str)
