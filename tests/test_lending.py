"""Lending and headroom by hand."""

import datetime as dt

import pytest

from twinleg.operators import lending as L


def day(d):
    return dt.date(2024, 1, 1) + dt.timedelta(d)


def test_the_current_row_is_the_last_ranked_one(spark):
    rows = [("p", day(i), 100 + i, i if i else None) for i in range(8)] + [("q", day(0), 5, 1)]
    now = {r["pair_id"]: r for r in L.lending_now(spark.createDataFrame(rows, "pair_id string, date date, balance long, net long"), 5, 3).collect()}
    assert set(now) == {"p"}  # q has too little history
    p = now["p"]
    assert (p["as_of"], p["balance"], p["rank"], p["net_recent"], p["n"]) == (day(7), 107, 1.0, 3 + 4 + 5 + 6 + 7, 6) and p["state"] == "tight"


def test_the_ceiling_is_priced_on_common_legs(spark):
    now = spark.createDataFrame([("p", day(9), 1000, 0.5, "normal"), ("q", day(9), 10, 0.1, "low")], "pair_id string, as_of date, balance long, rank double, state string")
    legs = spark.createDataFrame([("p", day(8), 50.0, 20.0)], "pair_id string, date date, local double, fx double")
    got = {r["pair_id"]: (r["on_loan_usd"], r["available"]) for r in L.borrow_ceiling(now, legs).collect()}
    assert got == {"p": (2500.0, True), "q": (None, False)}


def test_readiness_counts_days_once(spark):
    captures = spark.createDataFrame([(p, day(i)) for p, n in (("a", 60), ("b", 59), ("c", 61)) for i in range(n)] + [("b", day(0)), ("b", None)], "pair_id string, day date")
    pairs = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", None)], "pair_id string, fitted boolean")
    ready = L.readiness(captures, pairs)
    assert {tuple(r) for r in ready.collect()} == {("a", 60, True, True), ("b", 59, False, False), ("c", 61, True, False), ("d", 0, False, False)}
    assert tuple(L.ablation(ready).first()) == (4, 2, 1, True) and not L.ablation(ready.where("pair_id <> 'a'")).first()["ablatable"]


@pytest.fixture
def rooms(spark):
    rows = [("k", day(0), 1000), ("k", day(1), 1000), ("k", day(2), 1100), ("k", day(3), 1098), ("k", day(4), 1000), ("k", day(5), None), ("s", day(0), 40), ("s", day(6), 0), ("o", day(2), 7)]
    return spark.createDataFrame(rows, "programme string, date date, headroom long")


def test_ledgers_and_publication(spark, rooms):
    programmes = spark.createDataFrame([("k", "x", "control"), ("s", "x", "capped"), ("o", "y", "capped"), ("n", "y", "control"), ("o2", "z", "capped"), ("k", "z", "control")], "programme string, house string, role string")
    states = L.ledger_state(rooms, programmes)
    got = {(r["programme"], r["house"]): r for r in states.collect()}
    k, s, o, n = got[("k", "x")], got[("s", "x")], got[("o", "y")], got[("n", "y")]
    assert (k["n"], k["level"], k["creations"], k["consumptions"], k["latest_move"], k["note"], k["last_date"]) == (5, 1000, 1, 2, -98, "", day(4))
    assert (s["level"], s["note"]) == (0, "sealed") and (o["n"], o["latest_move"], o["note"]) == (1, None, "single observation") and (n["n"], n["level"], n["note"]) == (0, None, "not landed")
    assert {r["house"]: r["verdict"] for r in L.publication(states, "house").collect()} == {"x": L.ALIGNED, "y": L.SILENT, "z": L.ALIGNED}
    late = states.where("programme <> 's' or house <> 'x'").unionByName(states.where("programme = 'o'").selectExpr("programme", "'x' AS house", *states.columns[2:]))
    assert {r["house"]: r["verdict"] for r in L.publication(late, "house").collect()}["x"] == L.PUBLISHING


def test_episodes_are_measured_by_the_last_level(rooms):
    got = {(r["date"], r["delta"], r["direction"]) for r in L.flow_episodes(rooms, 0.0025).collect()}
    assert got == {(day(2), 100, "creation"), (day(4), -98, "consumption")}  # -2 of 1000 is under 0.25 %; a level of nought has no scale
    assert L.flow_episodes(rooms.limit(0)).count() == 0
