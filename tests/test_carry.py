"""Carry by hand: legs at their own dates, signs, totals, solved thresholds, margin returns and the fan."""

import datetime as dt

import pytest

from twinleg.operators import carry as C

LEGS = "pair_id string, earned_pct double, paid_pct double"
LEVELS = "pair_id string, pi double, half_life double"


def day(m, d=1):
    return dt.date(2024, m, d)


def test_legs_stand_at_their_own_last_date(spark):
    rows = [("p", "earned", day(1, 2), 5.0), ("p", "earned", day(1, 3), 4.0), ("p", "earned", day(1, 4), None), ("p", "paid", day(1), 2.5), ("q", "earned", day(2), 1.0), ("p", "other", day(3), 9.0), ("p", "paid", None, 8.0)]
    got = {r["pair_id"]: r for r in C.rate_legs(spark.createDataFrame(rows, "pair_id string, leg string, date date, rate double")).collect()}
    p = got["p"]
    assert (p["earned_pct"], p["earned_as_of"], p["earned_n"], p["paid_pct"], p["paid_as_of"], p["paid_n"]) == (4.0, day(1, 3), 2, 2.5, day(1), 1)
    assert p["differential_bp"] == pytest.approx(150.0) and got["q"]["differential_bp"] is None and got["q"]["paid_n"] == 0


def test_the_earned_rate_is_a_gain_and_unknown_parts_are_named(spark):
    legs = spark.createDataFrame([("p", 4.0, 2.5), ("q", 1.0, None)], LEGS)
    parts = C.components(legs, 126.0)
    got = {(r["pair_id"], r["bracket"], r["component"]): r["bp_year"] for r in parts.collect()}
    assert got[("p", "mid", C.EARNED)] == -400 and got[("p", "mid", C.PAID)] == 250 and got[("p", "high", C.SPECIAL)] == 900 and got[("p", "low", C.FEE)] == 14
    levels = spark.createDataFrame([("p", 0.1007, 126.0)], LEVELS)
    totals = {(r["pair_id"], r["bracket"]): r for r in C.summary(parts, levels, 126.0).collect()}
    mid = totals[("p", "mid")]
    assert mid["total_bp"] == pytest.approx(264) and mid["funding_bp"] == -150 and mid["tailwind"] and mid["unmeasured"] == C.BASIS
    assert mid["critical_bp"] == pytest.approx((1e4 * 0.1 * 0.5 - 7) * 2) and mid["headroom_bp"] == pytest.approx(986 - 264) and mid["pays"]
    assert totals[("q", "mid")]["total_bp"] is None and totals[("q", "mid")]["pays"] is None
    moved = {r["bracket"]: r for r in C.rate_shift(C.summary(parts, levels, 126.0).where("pair_id = 'p'"), 25.0).collect()}
    assert moved["mid"]["after_rise_bp"] == pytest.approx(239) and moved["mid"]["after_cut_bp"] == pytest.approx(289)


def test_the_waterfall_runs_to_its_sum_and_stress_costs(spark):
    legs = spark.createDataFrame([("p", 4.0, 2.5)], LEGS)
    sums = lambda **k: {r["special_bp"]: r["running_month"] for r in C.waterfall(legs, [150, 900], k.pop("basis", 0.0), **k).where("place = 6").collect()}
    assert sums()[150.0] == pytest.approx((-400 + 250 + 125 + 7 + 150) / 12)
    assert sums()[900.0] - sums()[150.0] == pytest.approx(750 / 12)
    assert sums(basis=-50.0)[150.0] - sums()[150.0] == pytest.approx(50 / 12)  # a basis below nought costs
    assert sums(times=2.0)[150.0] - sums()[150.0] == pytest.approx(125 / 12) and sums(times=2.0, locked=True) == sums()
    assert {r["status"] for r in C.waterfall(legs, [150], 0.0).where("component in ('name special', 'currency basis')").collect()} == {"BRACKETED"}


def test_the_table_adds_up(spark):
    legs = spark.createDataFrame([("p", 4.0, 2.5), ("q", 4.0, None), ("r", 1.0, 1.0)], LEGS)
    levels = spark.createDataFrame([("p", 0.1007, 252.0), ("q", 0.1, 252.0)], LEVELS)
    table = {(r["pair_id"], r["line"]): (r["bp150"], r["bp900"]) for r in C.waterfall_table(C.waterfall(legs, [150, 900], 0.0), levels, [150, 900]).collect()}
    assert len(table) == 30
    assert table[("p", C.SUBTOTAL)] == pytest.approx((-18 / 12, -18 / 12)) and table[("p", C.ALL_IN)] == pytest.approx((11, 73.5))
    assert table[("p", C.BREAKEVEN)] == pytest.approx((493 / 12,) * 2) and table[("p", C.HEADROOM)] == pytest.approx((493 / 12 - 11, 493 / 12 - 73.5))
    assert table[("q", C.ALL_IN)] == (None, None) and table[("q", C.SUBTOTAL)] == (None, None) and table[("q", C.HEADROOM)] == (None, None)
    assert table[("r", C.BREAKEVEN)] == (None, None) and table[("r", C.ALL_IN)] == pytest.approx((282 / 12, 1032 / 12))


def test_thresholds_solve_the_surface(spark):
    legs = spark.createDataFrame([("p", 4.0, 2.5)], LEGS)
    levels = spark.createDataFrame([("p", 0.1007, 100.0, 252.0, None)], "pair_id string, pi double, lower double, point double, upper double")
    special = {(r["bound"], r["state"]): r["special_bp"] for r in C.threshold_special(legs, levels).collect()}
    assert special[("point", "base")] == pytest.approx(493 - (-150 + 125 + 7)) and ("upper", "base") not in special
    assert special[("point", C.LOCKED)] - special[("point", "crisis")] == pytest.approx(125) == special[("lower", C.LOCKED)] - special[("lower", "crisis")]
    assert special[("point", "base")] - special[("point", C.LOCKED)] == pytest.approx(50)  # locking doesn't buy back the basis
    at = special[("point", "base")]
    grid = C.surface(legs, levels.withColumn("upper", levels["point"]), [at - 60, at, at + 60], 0.0, at + 1).collect()
    assert {r["special_bp"]: round(r["net_month"], 6) for r in grid if r["half_life"] == 252} == {at - 60: 5.0, at: 0.0, at + 60: -5.0}
    assert [(r["special_bp"], r["half_life"]) for r in grid if r["marked"]] == [(at, 252.0)]
    assert not any(r["marked"] for r in C.surface(legs, levels, [1.0], 0.0).collect())
    lives = {r["half_life"] for r in C.surface(legs, levels, [1.0], 0.0).collect()}
    assert min(lives) == 100 and max(lives) == 400 and len(lives) == 13  # the open end stops at the longest horizon


def test_margin_returns(spark):
    legs = spark.createDataFrame([("p", 4.0, 2.5)], LEGS)
    rows = {(r["move_pp"], r["sessions"]): r for r in C.margin_returns(legs, [-10.0, 10.0], [118.0], [126, 252], 0.0).collect()}
    assert rows[(-10.0, 252)]["gain_pct"] == pytest.approx(9.0) and rows[(-10.0, 126)]["gain_pct"] == pytest.approx(9.5) and rows[(10.0, 252)]["on_margin"] == pytest.approx(-0.55)
    assert rows[(10.0, 252)]["status"] == "ILLUSTRATIVE" and C.margin_returns(legs, [0.0], [0.0], [1], 0.0, 10.0).first()["status"] == "MEASURED"


def test_the_fan_widens_by_the_root_of_time(spark):
    panel = spark.createDataFrame([("p", day(1, 1 + i), x) for i, x in enumerate((0.0, 0.01, 0.0, 0.01, 0.0))] + [("q", day(1), 0.3)], "pair_id string, date date, pi double")
    rows = {(r["pair_id"], r["t"]): r for r in C.gain_fan(panel, 252, {"mid": 400.0}).collect()}
    sd = (4 / 3) ** 0.5
    assert rows[("p", 0)]["high_pp"] == 0 and rows[("p", 252)]["financing_pp"] == pytest.approx(-4) and rows[("p", 252)]["high_pp"] == pytest.approx(-4 + sd * 252**0.5)
    assert rows[("p", 63)]["half_low_pp"] == pytest.approx(-1 - sd * 63**0.5 / 2) and rows[("q", 9)]["low_pp"] is None
    assert C.gain_fan(panel.limit(0), 5, {"mid": 1.0}).count() == 0
