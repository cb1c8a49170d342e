"""Hand-checkable arithmetic and identities of the premium panel."""

import datetime as dt

import pytest

from twinleg.operators import premium as P
from twinleg.operators import series as S


def day(i):
    return dt.date(2026, 7, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize("adr,local,fx,ratio,gap", [(100.0, 1e6, 1000.0, 0.1, 0.0), (122.0, 1e6, 1000.0, 0.1, 0.22), (95.0, 1e6, 1000.0, 0.1, -0.05), (171.875, 1000.0, 32.0, 5.0, 0.10)])
def test_premium_formula(spark, adr, local, fx, ratio, gap):
    legs = spark.createDataFrame([(adr, local, fx)], "adr double, local double, fx double")
    assert P.with_premium(legs, ratio).first()["pi"] == pytest.approx(gap, abs=1e-12)


def legs(spark, n=40):
    rows = [("p", day(i), 100.0 + (i * 7) % 11, 1e6 + (i * 13) % 17 * 1e3, 1000.0 + (i * 5) % 7, 10, 1.0, 1.0) for i in range(n)]
    return P.with_premium(spark.createDataFrame(rows, "pair_id string, date date, adr double, local double, fx double, volume long, high double, low double"), 0.1)


def test_decomposition_is_an_identity(spark):
    parts = P.decomposition(legs(spark))
    assert P.attribution(parts).first()["identity_error"] < 1e-12
    assert abs(P.variance_parts(parts).first()["residual"]) < 1e-12


def test_join_drops_sessions_without_a_leg(spark):
    bars = spark.createDataFrame([("p", "A", day(0), 1.0, 1.0, 1.0, 1), ("p", "N", day(0), 2.0, 1.0, 1.0, 1), ("p", "A", day(1), 1.0, 1.0, 1.0, 1)], "pair_id string, leg string, date date, close double, high double, low double, volume long")
    fx = spark.createDataFrame([(day(0), 1.0), (day(1), 1.0)], "date date, fx double")
    joined = P.join_legs(bars, fx)
    assert [r["date"] for r in joined.collect()] == [day(0)]
    assert P.join_loss(bars, joined).first()["dropped"] == 1


def test_as_of_carries_only_backward(spark):
    facts = spark.createDataFrame([("p", day(0)), ("p", day(2)), ("p", day(5))], "pair_id string, date date")
    slow = spark.createDataFrame([("p", day(1), 7.0), ("p", day(5), 8.0)], "pair_id string, date date, ratio double")
    assert [r["ratio"] for r in P.as_of(facts, slow, "pair_id", "ratio").orderBy("date").collect()] == [None, 7.0, 8.0]


def test_folds_are_disjoint_and_embargoed(spark):
    report = S.fold_report(S.walk_forward(legs(spark, 60), 5, 3)).orderBy("fold").collect()
    assert [r["test"] for r in report] == [10] * 5 and all(r["embargoed"] == 3 for r in report)
    assert [r["train"] for r in report] == [7, 17, 27, 37, 47]


def test_rank_leaves_itself_out(spark):
    rows = spark.createDataFrame([("p", day(i), float(i)) for i in range(70)], "pair_id string, date date, pi double")
    out = S.trailing_rank(rows, 50, 30).orderBy("date").collect()
    assert out[28]["rank"] is None and all(r["rank"] == 1.0 and r["state"] == "tight" for r in out[29:])


def test_projection_equals_numpy(spark):
    import numpy as np

    noise, x = np.random.default_rng(1).normal(0, 0.1, 400), [1.0]
    for e in noise:
        x.append(0.9 * x[-1] + e)
    x = np.array(x)
    rows = spark.createDataFrame([("p", day(i), float(v)) for i, v in enumerate(x)], "pair_id string, date date, pi double")
    rho = {r["h"]: (r["n"], r["rho"]) for r in S.local_projection(rows, [1, 5]).collect()}
    for h in (1, 5):
        a, b = x[:-h] - x[:-h].mean(), x[h:] - x[h:].mean()
        assert rho[h] == (len(a), pytest.approx((a * b).sum() / ((a * a).sum() + 1e-4), abs=1e-9))
    assert rho[1][1] > rho[5][1]


def test_series_digest_depends_on_every_row_and_column(spark):
    from pyspark.sql import functions as F

    from twinleg.plans.panel import series_digest

    rows = [("p", "A", f"2020-01-0{i}", 1.0 * i, 2.0 * i, 0.5 * i, 10 * i) for i in range(1, 6)]
    digest = lambda r: series_digest(spark.createDataFrame(r, "pair_id string, leg string, date string, close double, high double, low double, volume long").withColumn("date", F.to_date("date"))).first()["digest"]
    changed = [[(*r[:k], r[k] + 1, *r[k + 1 :]) if i == j else r for j, r in enumerate(rows)] for i in range(5) for k in range(3, 7)]
    assert len({digest(r) for r in [rows, rows[1:], *changed[::3]]}) == 2 + len(changed[::3]) and digest(rows[::-1]) == digest(rows)
