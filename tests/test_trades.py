"""Swings, folds, placebo, tests and half-lives by hand arithmetic, with empty tables and ties."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np

from twinleg.operators import inference as I
from twinleg.operators import trades as T


def _panel(spark, values, pair="p"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(pair, day + dt.timedelta(k), float(v)) for k, v in enumerate(values)], "pair_id string, date date, pi double")


def test_turning_points_open_with_a_drop_and_take_the_first_of_ties():
    x = np.array([0.1, 0.3, 0.3, 0.1, 0.0, 0.0, 0.1, 0.3, 0.2, 0.0])
    assert T.turning_points(x, 0.15) == [1, 4, 7]
    assert T.turning_points(np.array([0.1, 0.2, 0.3]), 0.15) == [] and T.turning_points(np.array([]), 0.1) == []


def test_swings(spark):
    found = T.swings(_panel(spark, [0.3, 0.1, 0.0, 0.1, 0.3, 0.0]), 0.15, 2).collect()
    assert [(r["direction"], round(r["move"], 6), r["days"]) for r in found] == [("compression", 0.3, 2), ("widening", 0.3, 2)]
    assert T.swings(_panel(spark, [0.1]).limit(0), 0.1, 1).count() == 0


def test_breakeven_is_null_where_carry_exceeds_the_room(spark):
    rows = T.breakeven(_panel(spark, [0.226, 0.0005, 0.001]), [252]).where("bracket = 'mid'").orderBy("pi").collect()
    assert [r["half_life"] for r in rows[:2]] == [None, None]
    assert math.isclose(rows[2]["half_life"], -252 / math.log2(1 - 0.0607 / (0.226 - 0.0007)))


def test_normal_tail(spark):
    from pyspark.sql import functions as F

    got = [r["p"] for r in spark.range(5).select(I.normal_tail(F.col("id").cast("double")).alias("p")).collect()]
    assert all(abs(p - math.erfc(z / math.sqrt(2))) < 2e-7 for z, p in enumerate(got))


def test_kernel_errors_equal_a_loop_over_lags(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=200))
    rows = {r["h"]: r for r in I.projections(_panel(spark, x), [1, 7]).collect()}
    for h in (1, 7):
        a, b = x[:-h] - x.mean(), x[h:] - x.mean()
        a0, b0 = a - a.mean(), b - b.mean()
        u = a0 * (b0 - rows[h]["rho"] * a0)
        meat = sum((1 if lag == 0 else 2) * (1 - lag / (h + 1)) * (u[lag:] * u[: len(u) - lag]).sum() for lag in range(h + 1))
        assert math.isclose(rows[h]["se"], math.sqrt(meat) / (a0 @ a0), rel_tol=1e-9)


def test_half_lives(spark):
    path = [("a", 1, 100, 0.9, 0.01), ("a", 2, 100, 0.6, 0.01), ("a", 4, 100, 0.4, 0.01), ("b", 1, 100, 0.2, 0.5), ("b", 2, 100, 0.1, 0.1), ("b", 4, 100, 0.1, 0.1), ("c", 1, 9, 0.9, 0.9), ("d", 1, 100, 0.99, 0.0), ("d", 2, 100, 0.98, 0.0), ("d", 4, 100, 0.96, 0.0)]
    got = {r["pair_id"]: r for r in I.half_lives(spark.createDataFrame(path, "pair_id string, h int, n long, rho double, se double"), 12.0).collect()}
    assert got["a"]["support"] == "interpolated" and math.isclose(got["a"]["point"], 3.0)
    assert (got["b"]["support"], got["b"]["point"], got["b"]["lower"], got["b"]["unbounded_above"]) == ("sub_resolution", 1.0, 0.0, True)
    assert got["c"]["support"] == "none" and got["d"]["support"] == "extrapolated" and got["d"]["point"] > 60


def test_purged_folds(spark):
    rows = I.purged_folds(_panel(spark, range(10)), 5, 2, 1).where("fold = 1").orderBy("date").collect()
    assert [r["role"] for r in rows] == ["train", "purged", "test", "test", "embargoed"] + ["train"] * 5


def test_placebo_keeps_the_values(spark):
    panel = _panel(spark, [3, 1, 2, 2])
    got = [r["placebo"] for r in I.placebo(panel, "1").collect()]
    assert sorted(got) == [1.0, 2.0, 2.0, 3.0] and I.placebo(panel.limit(0), "1").count() == 0


def test_pooled_tests(spark):
    tables = spark.createDataFrame([(10, 5, 4, 12), (0, 0, 0, 0)], "a long, b long, c long, d long")
    r = I.mantel_haenszel(tables).first()
    assert (r["strata"], r["odds_ratio"]) == (1, 6.0)
    z = I.two_proportions(spark.createDataFrame([(50, 100, 20, 100), (1, 2, 0, 0)], "k1 long, n1 long, k2 long, n2 long")).collect()
    assert [x["verdict"] for x in z] == ["HELD", "UNTESTABLE"]
