"""The fold table and its tracks against numpy, with planted leaks, short series and placebos."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleg.operators import folds as D

SIZES = {"A": 120, "B": 90, "C": 50}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(1)
    rows = [(p, datetime.date(2020, 1, 1) + datetime.timedelta(i), 0.2 + 0.1 * math.sin(i / 9) + rng.gauss(0, 0.02)) for p, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "pair_id string, date date, pi double")


@pytest.fixture(scope="module")
def features(panel):
    return panel.select("pair_id", "date", F.sin(F.col("pi") * 50).alias("rv20"), F.cos(F.unix_date("date") / 5.0).alias("dd60"), F.when(F.dayofmonth("date") > 2, F.rand(3)).alias("fx_trend20"))


def blocks(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r["pair_id"], r["h"], r["seed"], r["fold"]), {"train": [], "test": []})[r["role"]].append(r)
    return {k: {s: sorted(v, key=lambda r: r["rn"]) for s, v in sides.items()} for k, sides in out.items()}


def test_folds_by_hand(panel):
    got = blocks(D.fold_frame(panel, [5], cap=20))
    # A: 115 rows with a target, edges 19, 38, 57, 76, 95, 115; the first fold has 14 training rows, the least is 30
    spans = {k[0::3]: (v["train"][0]["rn"], v["train"][-1]["rn"], v["test"][0]["rn"], v["test"][-1]["rn"]) for k, v in got.items()}
    assert {k: v for k, v in spans.items() if k[0] == "A"} == {("A", 1): (13, 32, 38, 56), ("A", 2): (32, 51, 57, 75), ("A", 3): (51, 70, 76, 94), ("A", 4): (70, 89, 95, 114)}
    assert "C" not in {k[0] for k in got}  # 45 rows are under 60
    for (p, *_), v in got.items():
        assert all(abs(r["y"] - q["x"]) < 1e-15 for r, q in zip(v["test"], v["test"][5:], strict=False)), p


def test_families_drop_the_same_rows_in_every_arm(panel, features):
    frame = D.fold_frame(panel, [5], features, ("m5", "m6"))
    arms = {"base": ["x"], "m6": ["x", "fx_trend20"], "all": ["x", "rv20", "dd60", "fx_trend20"]}
    got = D.ridge_arms(frame, arms).collect()
    assert all(r["date"].day > 2 for r in got)
    want = {}
    for key, v in blocks(frame).items():
        for arm, cs in arms.items():
            x, xt = (np.array([[r[c] for c in cs] for r in v[s]]) for s in ("train", "test"))
            y = np.array([r["y"] for r in v["train"]])
            a = x - x.mean(0)
            beta = np.linalg.solve(a.T @ a + D.SHRINK * np.eye(len(cs)), a.T @ (y - y.mean()))
            want |= {(*key, arm, r["date"]): g for r, g in zip(v["test"], (xt - x.mean(0)) @ beta + y.mean(), strict=True)}
    assert len(got) == len(want) and all(abs(r["guess"] - want[(r["pair_id"], r["h"], r["seed"], r["fold"], r["arm"], r["date"])]) < 1e-9 for r in got)
    scores = D.fold_scores(D.ridge_arms(frame, arms), F.lit("one"), ["h", "arm"])
    assert {r["arm"]: r["n"] for r in D.ablation(scores).collect()} == {a: len(want) // 3 for a in ("m6", "all")}
    with pytest.raises(Exception, match="different samples"):
        D.ablation(scores.withColumn("n", F.when(F.col("arm") == "m6", F.col("n") - 1).otherwise(F.col("n")))).collect()


def test_placebo_deals_the_same_targets(panel):
    real, dealt = (blocks(D.fold_frame(panel, [5], seeds=s)) for s in ((), ("1", "2")))
    whole = lambda b, seed: sorted({(k[0], r["rn"], r["y"]) for k, v in b.items() if k[2] == seed for s in v.values() for r in s})
    for seed in "12":
        a, b = whole(real, ""), whole(dealt, seed)
        assert [x[:2] for x in a] == [x[:2] for x in b] and a != b
    assert whole(dealt, "1") != whole(dealt, "2")


@pytest.mark.parametrize("p", [2, 7, 90])
def test_the_dual_is_the_primal(panel, p):
    frame = D.fold_frame(panel, [5], target="change", cap=40)
    got = {(r["pair_id"], r["fold"], r["date"], r["shrinkage"]): r["guess"] for r in D.random_features(frame, [p], [1e-2, 1.0], 5).collect()}
    for (pair, _, _, fold), v in blocks(frame).items():
        w, b = D.draws(p, pair, fold, 5)
        x, xt = (np.array([r["x"] for r in v[s]]) for s in ("train", "test"))
        y = np.array([r["y"] for r in v["train"]])
        z, zt = (np.sqrt(2 / p) * np.cos(np.outer((s - x.mean()) / (x.std() + 1e-12), w) + b) for s in (x, xt))
        for shrink in (1e-2, 1.0):
            beta = np.linalg.solve(z.T @ z + shrink * np.eye(p), z.T @ (y - y.mean()))
            assert all(abs(got[(pair, fold, r["date"], shrink)] - g) < 1e-8 for r, g in zip(v["test"], zt @ beta + y.mean(), strict=True))


def test_draws_are_spread():
    u = D.uniform(np.arange(30_000), 12345)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01 and 0 < u.min() and u.max() < 1
    w, b = D.draws(20_000, "A", 1, 7)
    assert abs(w.mean()) < 0.05 and abs(w.std() - 1) < 0.05 and abs(b.mean() - math.pi) < 0.1


def test_leaks_are_found(panel):
    frame = D.fold_frame(panel, [5])
    assert D.leakage(frame).count() == 0
    late = frame.where("pair_id = 'A' and fold = 2 and role = 'test' and rn = 57").withColumn("role", F.lit("train")).withColumn("rn", F.lit(54))
    both = frame.where("pair_id = 'B' and fold = 4 and role = 'test'").withColumn("role", F.lit("train"))
    got = {(r["pair_id"], r["fold"], r["rule"]): r["n"] for r in D.leakage(frame.unionByName(late).unionByName(both)).collect()}
    assert got[("A", 2, "embargo")] == 54 - 57 + 6 and ("A", 2, "overlap") not in got and got[("B", 4, "overlap")] > 0


def test_degenerate_families_and_leaking_placebos(spark):
    deltas = spark.createDataFrame([(5, "m5", "big", 90, -0.2), (5, "m5", "small", 10, 0.1), (5, "m5", "pooled", 100, -0.1), (5, "m6", "big", 90, 0.2), (5, "m6", "small", 10, 0.1), (5, "m6", "pooled", 100, -0.1)], "h int, arm string, regime string, n long, d_r2 double")
    assert {r["arm"]: r["degenerate"] for r in D.degenerate(deltas).collect()} == {"m5": True, "m6": False}
    real = spark.createDataFrame([(5, "a", 9, 0.5, 0.6), (5, "b", 9, 0.5, 0.6)], "h int, regime string, n long, r2 double, hit_rate double")
    fake = spark.createDataFrame([(5, "a", 0.01, 0.5), (5, "a", 0.05, 0.5), (5, "b", -0.1, 0.51)], "h int, regime string, r2 double, hit_rate double")
    assert {r["regime"]: (r["leak"], r["seeds"]) for r in D.against_placebo(real, fake).collect()} == {"a": (True, 2), "b": (False, 1)}
