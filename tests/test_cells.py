"""Conditional tables by hand: empty states, excluded pairs with reasons, pooled verdicts."""

import datetime

import pytest

from twinleg.operators import cells as C

DAY = datetime.date(2024, 1, 1)
day = lambda i: DAY + datetime.timedelta(i)
STARTED = "pair_id string, start_date date, direction string, channel string, state string"
REGISTRY = "pair_id string, regime string, forward_test boolean"


def started(spark, rows):
    return spark.createDataFrame([(p, day(i), "compression" if down else "widening", channel, state) for i, (p, down, channel, state) in enumerate(rows)], STARTED)


def test_state_is_that_of_the_start(spark):
    found = spark.createDataFrame([("A", day(1)), ("A", day(2)), ("B", day(1))], "pair_id string, start_date date")
    states = spark.createDataFrame([("A", day(1), "strength"), ("A", day(3), "weakness"), ("A", day(2), None)], "pair_id string, date date, state string")
    assert [tuple(r) for r in C.state_at_start(found, states).collect()] == [("A", day(1), "strength")]


def test_every_state_has_a_row(spark):
    rows = started(spark, [("A", True, "local_leg", "strength"), ("A", True, "fx_leg", "strength"), ("A", False, "adr_leg", "strength"), ("A", False, "adr_leg", "weakness")])
    pairs = spark.createDataFrame([("A",), ("B",)], "pair_id string")
    got = {(r["pair_id"], r["state"]): tuple(r)[2:] for r in C.conditional_channels(rows, pairs, 2).collect()}
    none = (0, 0, None, None, None, False)
    assert got.pop(("A", "strength")) == (3, 2, pytest.approx(2 / 3), 0.5, 0.0, True)
    assert got.pop(("A", "weakness")) == (1, 0, 0.0, None, None, False)
    assert len(got) == 4 and set(got.values()) == {none}


def test_excluded_pairs_stay_with_reasons(spark):
    registry = spark.createDataFrame([("A", "c", False), ("B", "c", False), ("C", "c", False), ("D", "f", False), ("E", "f", False), ("F", "f", True)], REGISTRY)
    panel = spark.createDataFrame([(p, day(i)) for p, n in {"A": 4, "B": 2, "D": 4, "E": 4, "F": 4}.items() for i in range(n)], "pair_id string, date date")
    rows = started(spark, [("A", True, "local_leg", "strength"), ("A", True, "adr_leg", "weakness"), ("A", False, "adr_leg", "weakness"), ("B", True, "adr_leg", "weakness"), ("D", True, "fx_leg", "strength")])
    got = {r["pair_id"]: r for r in C.pair_tables(panel, rows, rows, registry, 3, 2).collect()}
    assert {p: r["why"] for p, r in got.items()} == {"A": "", "B": "under 3 sessions", "C": "legs unavailable", "D": "under 2 usable episodes", "E": "no episodes at the base rule"}
    assert tuple(got["A"][c] for c in "abcd") == (1, 0, 0, 1) and got["A"]["n_compressions"] == 2 and got["A"]["strength_local_share"] == 1.0
    assert got["D"]["n_compressions"] == 1 and got["B"]["a"] is None and got["E"]["a"] is None


def test_scopes(spark):
    cells = "pair_id string, regime string, a long, b long, c long, d long, included boolean"
    tables = spark.createDataFrame([("A", "c", 30, 5, 8, 25, True), ("B", "f", 4, 6, 5, 5, True), ("C", "f", None, None, None, None, False)], cells)
    got = {r["scope"]: r for r in C.scope_verdicts(tables, "c", 0.025).collect()}
    # one stratum of 68: odds 30 * 25 / (5 * 8); expected 35 * 38 / 68, variance 35 * 33 * 38 * 30 / (68 ** 2 * 67)
    chi = (abs(30 - 35 * 38 / 68) - 0.5) ** 2 / (35 * 33 * 38 * 30 / (68**2 * 67))
    assert got["primary"]["odds_ratio"] == pytest.approx(18.75) and got["primary"]["chi2"] == pytest.approx(chi) and got["primary"]["verdict"] == "HELD"
    assert (got["all"]["n_pairs"], got["all"]["n_excluded"], got["all"]["n_episodes"]) == (2, 1, 88)
    empty = {r["scope"]: r for r in C.scope_verdicts(tables.where("not included"), "f", 0.025).collect()}
    assert {s: (r["n_pairs"], r["n_episodes"], r["odds_ratio"], r["verdict"]) for s, r in empty.items()} == {"all": (0, 0, None, "NULL"), "primary": (0, 0, None, "NULL")}


def test_missing_member_raises(spark):
    registry = spark.createDataFrame([("A", "c", False)], REGISTRY)
    C.require_members(registry, ["A"])
    with pytest.raises(ValueError, match="lacks B"):
        C.require_members(registry, ["A", "B"])
