"""Pooled paths against a direct sum over lags, the order of classes, and gaps of classes by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from twinleg.operators import persistence as P
from twinleg.operators.risk import horizon_grid


def series(rho, n, seed, mean=0.0):
    rng, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x = rho * x + rng.gauss(0, 0.01)
        out.append(mean + x)
    return out


def frame(spark, pairs):
    rows = [(p, c, dt.date(2000, 1, 1) + dt.timedelta(i), v) for p, (c, vs) in pairs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "pair_id string, class string, date date, pi double")


def direct(stack, h, shrink=1e-4):
    """Slope, intercept, R squared and error of stacked series by loops."""
    xy = [(x, y) for vs in stack for x, y in zip(vs, vs[h:])]
    n, mx, my = len(xy), sum(x for x, _ in xy) / len(xy), sum(y for _, y in xy) / len(xy)
    sxx, sxy = sum((x - mx) ** 2 for x, _ in xy), sum((x - mx) * (y - my) for x, y in xy)
    rho = sxy / (sxx + shrink)
    left = [y - my - rho * (x - mx) for x, y in xy]
    u = [(x - mx) * r for (x, _), r in zip(xy, left)]
    meat = sum(a * a for a in u) + sum(2 * (1 - lag / (h + 1)) * sum(a * b for a, b in zip(u[lag:], u)) for lag in range(1, min(h, n - 1) + 1))
    return n, rho, my - rho * mx, 1 - sum(r * r for r in left) / sum((y - my) ** 2 for _, y in xy), meat**0.5 / sxx


@pytest.mark.parametrize("block", [7, 4096])
def test_path_equals_the_direct_sums(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    pairs = {"a": ("one", series(0.9, 150, 1, 3.0)), "b": ("one", series(0.5, 90, 2, -1.0)), "c": ("two", series(0.97, 120, 3)), "d": (None, series(0.1, 80, 4)), "e": ("two", series(0.2, 6, 5))}
    got = {(r["regime"], r["h"]): r for r in P.pooled_path(frame(spark, pairs), F.col("class"), [1, 3, 10, 20, 40, 60]).collect()}
    mean = lambda vs: [v - sum(vs) / len(vs) for v in vs]
    members = {"one": "ab", "two": "ce", P.POOLED: "abce"}
    for name, ps in members.items():
        for h in (1, 3, 10, 20, 40, 60):
            want = direct([mean(pairs[p][1]) for p in ps], h) if any(len(pairs[p][1]) > h for p in ps) else (0,)
            alive = all(direct([mean(pairs[p][1]) for p in ps], k)[0] / k >= 5 for k in (1, 3, 10, 20, 40, 60) if k <= h)
            if not alive:
                assert (name, h) not in got
                continue
            r = got[(name, h)]
            assert (r["n"], r["pairs"]) == (want[0], len(ps)) and (r["rho"], r["alpha"], r["r2"], r["se"]) == pytest.approx(want[1:], rel=1e-8, abs=1e-12)
            assert r["t"] == pytest.approx(want[1] / want[4]) and r["identified"] == (want[0] / h >= 12)
    assert ("one", 20) in got and ("two", 40) not in got


def test_null_and_flat_gaps(spark):
    flat = frame(spark, {"a": ("one", [0.5] * 40), "n": ("one", [None] * 9)})
    rows = P.pooled_path(flat, F.col("class"), [1]).collect()
    assert [(r["n"], r["pairs"], r["rho"], r["r2"], r["se"], r["t"]) for r in rows] == [(39, 1, 0.0, None, None, None)] * 2
    assert P.pooled_path(flat.limit(0), F.col("class"), [1]).count() == 0


def test_metrics_put_the_pooled_rows_last(spark):
    rows = P.metrics(P.pooled_path(frame(spark, {"a": ("z", series(0.98, 400, 7)), "b": ("y", series(0.2, 400, 8))}), F.col("class"), horizon_grid(60)), [1, 5]).orderBy("place").collect()
    assert [(r["regime"], r["h"]) for r in rows] == [("y", 1), ("y", 5), ("z", 1), ("z", 5), (P.POOLED, 1), (P.POOLED, 5)]
    assert rows[0]["support"] == "sub_resolution" and rows[2]["support"].startswith("interpolated") and rows[2]["half_life"] > 5


def test_classes_differ_by_dynamics_or_by_size(spark):
    pairs = {"s1": ("slow", series(0.985, 900, 1, 0.2)), "s2": ("slow", series(0.985, 900, 2, 0.3)), "f1": ("fast", series(0.8, 900, 3, 0.2)), "f2": ("fast", series(0.0, 900, 4, 0.1)), "o": ("other", series(0.9, 900, 5, 9.0))}
    row = P.class_gaps(frame(spark, pairs), F.col("class"), "slow", "fast", horizon_grid(100)).first()
    assert (row["slow_pairs"], row["fast_pairs"], row["slow_lives"], row["fast_lives"]) == (2, 2, 2, 1)  # f2 is below one step
    level = lambda p: abs(sum(pairs[p][1]) / 900)
    assert row["level_gap"] == pytest.approx(min(level("s1"), level("s2")) / max(level("f1"), level("f2"))) and row["dynamics_gap"] > 2 and row["informative"] == (row["dynamics_gap"] > 2 * row["level_gap"])
    none = P.class_gaps(frame(spark, pairs), F.col("class"), "slow", "nobody", horizon_grid(20)).first()
    assert none["level_gap"] is None and none["informative"] is None and none["fast_pairs"] == 0
