"""Risk, capacity and pooled persistence by hand arithmetic and identities."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from twinleg.operators import risk as R


def panel(spark, rows):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    return spark.createDataFrame([(p, day(i), a, l, x, a * x / l - 1) for p, i, a, l, x in rows], "pair_id string, date date, adr double, local double, fx double, pi double")


def test_variance_shares_sum_to_one(spark):
    rows = [("p", i, 10 + math.sin(i), 9 + math.cos(2 * i), 1 + 0.1 * math.sin(3 * i)) for i in range(60)]
    r = R.return_variance(panel(spark, rows)).first()
    assert sum(r[c] for c in r.asDict() if c.startswith("share_")) == pytest.approx(1) and r["residual"] < 1e-12 and r["n"] == 59 and not r["descriptive"]


def test_locked_gap_needs_no_pair_margin(spark):
    rows = [("p", i, 10.0 * (1.1 if i % 2 else 1.0), 10.0 * (1.1 if i % 2 else 1.0), 1.0) for i in range(12)]
    calls = R.margin_calls(panel(spark, rows)).collect()
    assert all(abs(c["total_pair"]) < 1e-12 for c in calls) and calls[0]["total_standalone"] > 0.1
    peak = R.peak_calls(R.margin_calls(panel(spark, rows)), [100.0]).first()
    assert peak["sessions"] == 12 and peak["pair_usd"] == pytest.approx(0, abs=1e-9)


def test_margin_follows_the_log_loss(spark):
    rows = [("p", 0, 1.0, 1.0, 1.0), ("p", 1, 1.2, 1.0, 1.0), ("p", 2, 0.9, 1.0, 1.0)]
    calls = sorted(R.margin_calls(panel(spark, rows)).collect(), key=lambda c: c["date"])
    moves = [math.log(1.2), math.log(0.9 / 1.2)]
    margin = 1.645 * math.sqrt(sum((m - sum(moves) / 2) ** 2 for m in moves))
    assert [c["total_pair"] for c in calls] == pytest.approx([margin, margin + math.log(1.2), margin])


def test_stress_days_are_the_pairs_own(spark):
    rows = [("p", i, 10.0 + (5.0 if i == 9 else 0.1 * (i % 2)), 10.0, 1.0) for i in range(11)]
    out = {r["stress"]: r for r in R.stress_volatility(panel(spark, rows)).collect()}
    assert out[True]["n"] == 2 and out[False]["n"] == 8 and out[True]["vol_pair"] > 10 * out[False]["vol_pair"]
    assert out[True]["vol_local"] == 0 and out[True]["ratio"] == pytest.approx(1)


def test_stress_volume_looks_back_only(spark):
    bars = spark.createDataFrame([("p", "A", dt.date(2020, 1, 1 + i), 10.0, 11.0 + (9 if i == 5 else 0), 10.0, 100 if i < 6 else 10**6) for i in range(8)], "pair_id string, leg string, date date, close double, high double, low double, volume long")
    r = R.stress_liquidity(bars).first()
    assert (r["stress_date"], r["volume_vs_trailing"], r["range_multiple"]) == (dt.date(2020, 1, 6), 1.0, 10.0)


def test_unwind_and_budget(spark):
    adv = spark.createDataFrame([("p", "A", 100.0), ("p", "N", 50.0)], "pair_id string, leg string, adv double")
    r = R.unwind_table(adv, [10.0], [1000]).first()
    assert (r["sessions_normal"], r["sessions_stressed"]) == (2.0, 20.0) and R.days_to_unwind(adv, [10.0], [1000]).first()["binding_leg"] == "local"
    axis = spark.createDataFrame([("p", "max", 2.5)], "pair_id string, excursion string, points double")
    assert R.drawdown_budget(axis, [5.0]).first()["max_notional"] == 2.0
    with pytest.raises(Exception, match="positive"):
        R.drawdown_budget(axis.withColumn("points", F.lit(0.0)), [5.0]).collect()


def test_pooled_path_stops_at_the_first_thin_horizon(spark):
    x, rows = 0.0, []
    for p in "ab":
        for i in range(60):
            x = 0.9 * x + math.sin(7.0 * i * i)
            rows.append((p, i, 10 + x, 10.0, 1.0))
    out = R.pooled_projection(panel(spark, rows), F.when(F.col("pair_id") == "a", "r").otherwise("q"), [1, 5, 20, 2]).collect()
    got = {(r["regime"], r["h"]): r["n"] for r in out}
    assert got == {**{(k, h): 60 - h for k in "rq" for h in (1, 2, 5)}, **{(None, h): 2 * (60 - h) for h in (1, 2, 5)}}
    assert {r["h"]: r["rho"] for r in out if r["regime"] == "r"}[1] > 0.3


def test_dollar_volume_carries_fx_and_keeps_the_last_session(spark):
    day = lambda d: dt.date(2020, 1, d)
    bars = [("p", leg, day(d), 10.0 * d, 100) for leg in "ANR" for d in range(1, 7)]
    fx = [(day(d), float(d)) for d in (2, 3, 5)] + [(dt.date(2019, 12, 31), 7.0)]  # 2019-12-31 is no session of the leg
    got = R.dollar_volume(spark.createDataFrame(bars, "pair_id string, leg string, date date, close double, volume long"), spark.createDataFrame(fx, "date date, fx double"), 3, 2).orderBy("leg", "date").collect()
    adv = {(r["leg"], r["date"].day): r["adv"] for r in got}
    assert adv[("A", 2)] == 1500.0 and adv[("A", 6)] == 5000.0 and ("A", 1) not in adv and ("R", 3) not in {k[0] for k in adv}
    # local: 20/2, 30/3, 40/3 (carried), 50/5, 60/5 (carried), times 100; none on the first session
    assert ("N", 2) not in adv and adv[("N", 3)] == 1000.0 and abs(adv[("N", 6)] - 100 * (40 / 3 + 10 + 12) / 3) < 1e-9
    last = R.dollar_adv(spark.createDataFrame(bars, "pair_id string, leg string, date date, close double, volume long"), spark.createDataFrame(fx, "date date, fx double"), 3, 2).where("leg = 'N'").first()
    assert last["last_date"] == day(6) and last["n"] == 4 and last["caveat"] == "recent"


def test_stress_of_any_share(spark):
    adv = spark.createDataFrame([("p", "A", 100.0), ("p", "N", 50.0)], "pair_id string, leg string, adv double")
    assert [r["sessions_stressed"] for r in R.unwind_table(adv, [10.0], [5, 15]).orderBy("participation_bp").collect()] == pytest.approx([4000.0, 10 / (50 * 0.00015)])


def test_horizons():
    assert len(R.horizon_grid()) == 66 and R.horizon_grid()[-1] == 400 and R.horizon_grid(30) == [*range(1, 21), 25, 30]
