"""Providers, shared legs, sample limits, variants, coverage, instants and hedges by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinleg.operators import variants as V

PAIRS = "pair_id string, adr string, local string, fx string, ratio double, many_fx boolean, sample_start date, sample_end date, confirmed boolean, forward_test boolean, excluded boolean, class string, sample_reason string"


def day(d, m=1):
    return dt.date(2024, m, d)


def test_one_provider_serves_the_whole_series(spark):
    rows = spark.createDataFrame([("s", "second", 1), ("s", "second", 2), ("s", "third", 3), ("t", "stray", 1), ("u", "first", 1), ("u", "first", 1)], "series_id string, provider string, v int")
    chain = spark.createDataFrame([("s", "first", 0), ("s", "second", 1), ("s", "third", 2), ("t", "second", 1), ("t", "first", 0), ("u", "first", 0), ("u", "first", 3)], "series_id string, provider string, place int")
    assert sorted(map(tuple, V.first_provider(rows, chain).collect())) == [("s", "second", 1), ("s", "second", 2), ("u", "first", 1), ("u", "first", 1)]
    assert [tuple(r) for r in V.unserved(rows, chain).collect()] == [("t", "first > second")]
    assert V.first_provider(rows.limit(0), chain).count() == 0 and V.unserved(rows.limit(0), chain).count() == 3


def test_the_shared_leg_only_fills_what_is_lacking(spark):
    own = spark.createDataFrame([("a", 1)], "series_id string, v int")
    shared = spark.createDataFrame([("a", 9), ("a", 8), ("b", 2), ("b", 3)], "series_id string, v int")
    assert sorted(map(tuple, V.with_fallback(own, shared).collect())) == [("a", 1, "own"), ("b", 2, "shared"), ("b", 3, "shared")]


def test_a_start_may_only_narrow(spark):
    rows = spark.createDataFrame([(d, lo, hi) for d in (day(1), day(5), day(9)) for lo, hi in ((None, None), (day(5), day(5)))] + [(None, None, None)], "date date, sample_start date, sample_end date")
    kept = lambda start: sorted((r["date"].day, r["sample_start"] is None) for r in rows.where(V.within_sample(F.col("date"), start)).collect())
    assert kept(None) == [(1, True), (5, False), (5, True), (9, True)]
    assert kept("2024-01-06") == [(9, True)] and kept("2023-01-01") == kept(None)


@pytest.fixture
def market(spark):
    pairs = spark.createDataFrame(
        [("p", "p.a", "p.l", None, 10.0, True, day(2), None, True, True, False, "kept", "Split. More."), ("q", "q.a", "q.l", "fx.q", 1.0, False, None, None, False, False, False, None, ""), ("r", "r.a", "r.l", "fx.r", 1.0, False, None, None, False, False, False, None, None), ("x", "q.a", "q.l", "fx.q", 1.0, False, None, None, False, False, True, "kept", None)], PAIRS)
    bars = [("p.a", "official", d, 11.0) for d in (day(1), day(2), day(3))] + [("p.l", "official", d, 1.0) for d in (day(1), day(2), day(4))]
    bars += [(s, "other", day(2), 5.0) for s in ("p.a",)] + [("q.a", "official", day(1), 3.0), ("q.l", "official", day(1), 2.0), ("q.l", "official", day(7), None)]
    fx = spark.createDataFrame([("fx.1", d, 1.0) for d in (day(1), day(2), day(3), day(4))] + [("fx.2", day(3), 2.0), ("fx.q", day(1), 1.0)], "series_id string, date date, fx double")
    return spark.createDataFrame(bars, "series_id string, close_def string, date date, close double"), fx, pairs


def test_variants_exist_where_all_inputs_do(market):
    bars, fx, pairs = market
    legs = {"one": "fx.1", "two": "fx.2", "none": "fx.9"}
    rows = [(r["pair_id"], r["fx_leg"], r["close_def"], r["date"].day, round(r["pi"], 6)) for r in V.all_variants(bars, fx, pairs, legs).collect()]
    assert sorted(rows) == [("p", "one", "official", 2, 0.1), ("q", "native", "official", 1, 0.5), ("x", "native", "official", 1, 0.5)]
    table = {r["pair_id"]: r for r in V.variant_table(bars, fx, pairs, legs).collect()}
    assert (table["p"]["n"], table["p"]["dropped"], table["p"]["fx_series"], table["p"]["confirmed"]) == (1, 2, "fx.1", True)  # FX holds days 2, 3 and 4
    assert V.all_variants(bars, fx, pairs, legs, "2024-01-02").count() == 1 and V.all_variants(bars.limit(0), fx, pairs, legs).count() == 0


def test_coverage_names_what_takes_no_part(market):
    bars, fx, pairs = market
    rows = {r["pair_id"]: r for r in V.panel_coverage(pairs, V.variant_table(bars, fx, pairs, {"one": "fx.1"}), ["one"]).collect()}
    assert {k: r["label"] for k, r in rows.items()} == {"p": V.FORWARD, "q": V.WITHHELD, "r": V.UNREACHABLE, "x": V.EXCLUDED}
    assert rows["r"]["n"] == 0 and rows["r"]["first_date"] is None and rows["p"]["restriction"] == "Split" and rows["q"]["restriction"] is None


def test_summer_time_moves_the_instant(spark):
    bars = spark.createDataFrame([("a", day(15, 1)), ("a", day(15, 7)), ("k", day(15, 7)), ("z", day(15, 7))], "series_id string, date date")
    clocks = spark.createDataFrame([("a", "America/New_York", "16:00", 15), ("k", "Asia/Seoul", "15:30", 1080)], "series_id string, timezone string, close_local string, lag_min int")
    got = {(r["series_id"], r["date"].month): (r["o"], r["k"]) for r in V.instants(bars, clocks).selectExpr("series_id", "date", "date_format(observed_at, 'dd HH:mm') AS o", "date_format(known_at, 'dd HH:mm') AS k").collect()}
    assert got == {("a", 1): ("15 21:00", "15 21:15"), ("a", 7): ("15 20:00", "15 20:15"), ("k", 7): ("15 06:30", "16 00:30"), ("z", 7): (None, None)}


def test_the_rest_of_a_hedge_is_the_premium(spark):
    panel = spark.createDataFrame([("p", day(1), 9.0, 9.0, 9.0, 9.0), ("p", day(2), 122.0, 1_000_000.0, 1000.0, 0.22)], "pair_id string, date date, adr double, local double, fx double, pi double")
    row = V.fx_hedge(V.last_legs(panel), 0.1, 2.0).first()
    assert (row["local_notional"], row["local_usd"], row["adr_usd"]) == pytest.approx((200_000, 200, 244)) and row["residual_usd"] == pytest.approx(44)
    assert row["residual_share"] == pytest.approx(0.22 / 1.22) and row["identity_error"] == pytest.approx(0)
    coef = spark.createDataFrame([("p", 0.8, 0.6, 1.0)], "pair_id string, coef double, low double, high double")
    up, down = (V.fx_sensitivity(V.last_legs(panel), coef, [m]).first() for m in (0.01, -0.01))
    assert (up["analytic_pp"], up["central_pp"], up["low_pp"], up["high_pp"]) == pytest.approx((1.22, 0.976, 0.732, 1.22)) and down["low_pp"] == pytest.approx(-1.22)
    assert V.fx_sensitivity(V.last_legs(panel), coef.limit(0), [0.01]).first()["central_pp"] is None
