"""Decision tables and scenario paths by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinleg.operators import decisions as D


def test_the_table_is_complete_and_unique(spark):
    rows = D.decision_table(spark).collect()
    assert len(rows) == 27 == len({tuple(r[k] for k in D.STATES) for r in rows}) and {r["action"] for r in rows} == {D.HOLD, D.REDUCE, D.CONVERT, D.UNWIND}
    assert all(r["action"] == D.UNWIND for r in rows if r["margin_headroom"] == "critical")
    assert all(r["action"] == D.CONVERT for r in rows if r["borrow_state"] == "recalled" and r["margin_headroom"] != "critical")
    assert [r["premium_band"] for r in rows if r["action"] == D.HOLD] == ["mid", "above entry"]


def test_gaps_and_unknown_states_are_errors(spark):
    with pytest.raises(Exception, match="no rule for"):
        D.decision_table(spark, D.RULES[:-1]).collect()
    with pytest.raises(ValueError, match="no state"):
        D.decision_table(spark, [({"margin_headroom": "fine"}, D.HOLD)])


def test_positions_at_the_thresholds(spark):
    rows = [(1, 15.0, 400.0, False, 50.0), (2, 15.1, 400.1, False, 50.0), (3, 40.1, 10.0, True, 49.9), (4, 20.0, 10.0, False, 10.0), (5, 40.0, 10.0, False, 60.0), (6, None, 10.0, False, 60.0), (7, 20.0, None, True, 11.0)]
    df = spark.createDataFrame(rows, "id int, premium_pp double, borrow_bp double, recalled boolean, headroom_pct double")
    got = {r["id"]: r["action"] for r in D.decided(df, D.decision_table(spark)).collect()}
    assert got == {1: D.UNWIND, 2: D.REDUCE, 3: D.CONVERT, 4: D.UNWIND, 5: D.HOLD, 6: None, 7: D.CONVERT}


def test_tiers_use_the_real_states(spark):
    day = lambda d: dt.date(2024, 1, d)
    df = spark.createDataFrame([("a", day(1), "low", 0.1), ("a", day(2), "tight", 0.9), ("a", day(3), None, None), ("b", day(1), "normal", 0.5), ("c", day(1), "odd", 0.5)], "pair_id string, date date, state string, rank double")
    assert {r["pair_id"]: (r["tier"], r["as_of"].day) for r in D.indicated_tier(df).collect()} == {"a": ("long-local via TRS", 2), "b": ("standby", 1), "c": ("standby", 1)}


def test_paths_gains_and_margins(spark):
    panel = spark.createDataFrame([("p", dt.date(2024, 1, 1 + i), x, 1.0, 1.0, 1.0) for i, x in enumerate((0.1, 0.5, 0.3))], "pair_id string, date date, pi double, adr double, local double, fx double")
    paths = D.scenario_paths(panel, 4, 2.0, 0.1)
    level = {(r["path"], r["t"]): round(r["level"], 12) for r in paths.collect()}
    assert [level[("static", t)] for t in range(5)] == [0.3] * 5
    assert [level[("widening", t)] for t in range(5)] == [0.3, 0.7, 0.5, 0.5, 0.5]  # the moves are added, the last is held
    assert [level[("compression", t)] for t in (0, 2, 4)] == [0.3, 0.2, 0.15]
    gains = D.path_gains(paths, {"low": 0.0, "high": 2520.0})
    got = {(r["path"], r["bracket"], r["t"]): r["pnl"] for r in gains.collect()}
    assert got[("compression", "low", 4)] == pytest.approx(0.15) and got[("widening", "high", 1)] == pytest.approx(-0.4 - 0.001)
    flat = lambda df: df.select("pair_id").distinct().select("pair_id", F.lit(0.05).alias("initial"), F.lit(0.2).alias("peak"))
    ends = {(r["path"], r["bracket"]): r["margins"] for r in D.path_ends(gains, panel, flat).collect()}
    assert ends[("compression", "low")] == pytest.approx(3.0)
    assert [tuple(r)[1:] for r in D.margin_sizing(panel, [100.0], flat).collect()] == [(100.0, 5.0, 20.0, 4.0)]
