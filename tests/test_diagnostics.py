"""Strategy diagnostics against numpy, with block edges, and tenths with ties."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinleg.operators import diagnostics as G

SCHEMA = "regime string, pair_id string, h int, seed string, fold int, date date, y double, guess_a double, guess_b double, sigma double"


def made(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("r" if i % 3 else "s", "ab"[i % 2], 5, "", i * 4 // n, datetime.date(2020, 1, 1) + datetime.timedelta(i), *map(float, rng.normal(size=3)), float(1 + i * 4 // n)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def series(rows, regime):
    mine = sorted((r for r in rows if r[0] == regime), key=lambda r: (r[1], r[4], r[5]))
    return [np.array([r[k] for r in mine]) for k in (6, 7, 8, 9)]


def t_of(x, h):
    n, c = len(x), x - x.mean()
    lag = max(h - 1, 1)
    lrv = c @ c / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, min(lag, n - 1) + 1))
    b = x[::h]
    return x.mean() / x.std(ddof=1) * np.sqrt(n), x.mean() / np.sqrt(max(lrv, 1e-18) / n), b.mean() / b.std(ddof=1) * np.sqrt(len(b)), len(b)


@pytest.mark.parametrize(("h", "block"), [(5, 16), (1, 7), (20, 4096)])
def test_diagnostics(spark, monkeypatch, h, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rows, df = made(spark, 240)
    got = {r["regime"]: r for r in G.strategy_diagnostics(df, h).collect()}
    for regime in "rs":
        y, a, b, sigma = series(rows, regime)
        pa, pb, v, r = np.sign(a) * y, np.sign(b) * y, -y / sigma, got[regime]
        sharpe = lambda x: x.mean() / x.std(ddof=1) * np.sqrt(252 / h)
        assert [r["sharpe_a"], r["sharpe_b"], r["sharpe_short"], r["sharpe_vol_managed"]] == pytest.approx([sharpe(pa), sharpe(pb), sharpe(-y), sharpe(v)])
        load = np.cov(v, pb, ddof=0)[0, 1] / v.var()
        alpha = pb.mean() - load * v.mean()
        assert (r["alpha"], r["load"], r["n"]) == (pytest.approx(alpha), pytest.approx(load), len(y))
        assert (r["t_alpha_naive"], r["t_alpha_hac"], r["t_alpha_apart"], r["blocks"]) == pytest.approx(t_of(pb - load * v, h))
        assert (r["t_a_hac"], r["t_b_hac"]) == pytest.approx((t_of(pa, h)[1], t_of(pb, h)[1]))
        assert r["corr_side_sigma"] == pytest.approx(np.corrcoef(np.sign(b), sigma)[0, 1]) and r["turnover"] == pytest.approx(np.abs(np.diff(np.sign(b))).mean() / 2)


def test_few_rows_and_none(spark):
    rows, df = made(spark, 3)
    assert {r["regime"]: (r["n"], r["t_alpha_apart"]) for r in G.strategy_diagnostics(df, 20).collect()} == {"r": (2, 0.0), "s": (1, 0.0)}
    assert G.strategy_diagnostics(df.limit(0), 20).count() == G.magnitude_shares(df.limit(0)).count() == 0


def test_a_multiple_of_the_benchmark_has_no_alpha(spark):
    _, df = made(spark, 60)
    short = df.withColumn("guess_b", F.lit(-1.0)).withColumn("sigma", F.lit(0.3)).withColumn("regime", F.lit("t"))
    r = G.strategy_diagnostics(short, 5).collect()[0]
    assert (r["alpha"], r["t_alpha_naive"], r["t_alpha_hac"], r["t_alpha_apart"]) == (0, 0, 0, 0) and r["load"] == pytest.approx(0.3) and r["corr_side_sigma"] is None


def test_tenths(spark):
    rows, df = made(spark, 150)
    got = {(r["regime"], r["track"], r["tenth"]): r for r in G.magnitude_shares(df).collect()}
    y, a, b, _ = series(rows, "r")
    edges = np.quantile(np.abs(y), np.linspace(0, 1, 11))
    tenth = np.maximum(np.searchsorted(edges, np.abs(y), side="left"), 1)
    for track, guess in (("a", a), ("b", b)):
        gain = np.sign(guess) * y
        for k in range(1, 11):
            m, r = tenth == k, got["r", track, k]
            assert (r["n"], r["hit_rate"], r["gain_share"], r["mean_gain"]) == (m.sum(), pytest.approx((np.sign(guess) == np.sign(y))[m].mean()), pytest.approx(gain[m].sum() / np.abs(gain).sum()), pytest.approx(gain[m].mean()))
    assert sum(r["gain_share"] for (g, t, _), r in got.items() if (g, t) == ("r", "a")) == pytest.approx((np.sign(a) * y).sum() / np.abs(y).sum())


def test_equal_edges_count_once(spark):
    _, df = made(spark, 40)
    tied = df.withColumn("y", F.when(F.dayofmonth("date") < 25, 0.5).otherwise(F.col("y") * 9)).withColumn("regime", F.lit("t"))
    got = {r["tenth"]: r["n"] for r in G.magnitude_shares(tied).where("track = 'a'").collect()}
    y = np.array([abs(r["y"]) for r in tied.collect()])
    edges = np.unique(np.quantile(y, np.linspace(0, 1, 11)))
    want = np.maximum(np.searchsorted(edges, y, side="left"), 1)
    assert len(edges) < 11 and got == {k: int((want == k).sum()) for k in set(want.tolist())}


def test_sigma_is_that_of_the_training_rows(spark):
    day = lambda i: datetime.date(2020, 1, 1 + i)
    frame = spark.createDataFrame([("a", 5, "", 0, role, day(i), y) for i, (role, y) in enumerate([("train", 1.0), ("train", 3.0), ("test", 100.0)])] + [("b", 5, "", 0, "train", day(0), 1.0), ("b", 5, "", 0, "train", day(1), 1.0), ("b", 5, "", 0, "test", day(2), 2.0)], "pair_id string, h int, seed string, fold int, role string, date date, y double")
    guesses = frame.where("role = 'test'").select("pair_id", "h", "seed", "fold", "date", "y", F.lit(0.5).alias("guess"))
    got = {r["pair_id"]: (r["sigma"], r["guess_a"], r["guess_b"]) for r in G.paired(frame, guesses, guesses, F.lit("r")).collect()}
    assert got == {"a": (pytest.approx(np.sqrt(2)), 0.5, 0.5), "b": (1e-9, 0.5, 0.5)}
