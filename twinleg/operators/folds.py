"""One fold table for every forecasting track: feature families, capped training blocks, ridge arms, placebos and random features."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_pair

#: Columns of each feature family.
FAMILIES = {"m5": ["rv20", "dd60"], "m6": ["fx_trend20"]}
#: Least rows of a series and least training rows of a fold, and the ridge's shrinkage.
LEAST_ROWS, LEAST_TRAIN, SHRINK = 60, 30, 1e-4
POOLED = "pooled"
KEYS = ["pair_id", "h", "seed"]


def _trailing(n: int, by: str = "pair_id"):
    return Window.partitionBy(by).orderBy("date").rowsBetween(-(n - 1), 0)


def family_features(bars: DataFrame, fx: DataFrame) -> DataFrame:
    """(pair_id, date, rv20, dd60, fx_trend20) on the local leg's own sessions: annualised deviation of its last 20 log changes,
    distance from its 60-session high, and the change of its FX series over 20 quotes; null until a window is full."""
    local = bars.where("leg = 'N'").select("pair_id", "date", "close").withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(by_pair()))
    rv = F.when(F.count("r").over(_trailing(20)) >= 20, F.stddev_samp("r").over(_trailing(20)) * F.sqrt(F.lit(252.0)))
    high = F.when(F.count("close").over(_trailing(60)) >= 60, F.max("close").over(_trailing(60)))
    # one FX series: its window holds the calendar
    quotes = fx.withColumn("series", F.lit("fx"))
    trend = quotes.select("date", (F.col("fx") / F.lag("fx", 20).over(Window.partitionBy("series").orderBy("date")) - 1).alias("fx_trend20"))
    own = local.select("pair_id", "date", rv.alias("rv20"), (F.col("close") / high - 1).alias("dd60"))
    return own.join(trend.hint("merge"), "date", "left").select("pair_id", "date", "rv20", "dd60", "fx_trend20")


def fold_frame(
    panel: DataFrame, horizons: list[int], features: DataFrame | None = None, families: tuple[str, ...] = (), splits: int = 5, target: str = "level", seeds: tuple[str, ...] = (), cap: int | None = None
) -> DataFrame:
    """The fold table (pair_id, h, seed, fold, role, rn, date, x, y, level, family columns) that every track reads.

    y is pi ``h`` sessions on (target level) or the log change of 1 + pi to it (change); sessions without x, y or any column of
    ``families`` drop, whether an arm uses the columns or not, so all arms score the same rows.  With ``seeds`` y is dealt
    anew within each pair, once for each seed, in an order given by a digest; otherwise seed is empty.  Folds are expanding:
    test blocks follow a first part of n // (splits + 1) rows, and the ``h`` rows before a block don't train.  Series under
    60 rows and folds under 30 training rows drop; ``cap`` keeps the last ``cap`` training rows of a fold and all test rows.
    """
    ahead = [F.lead("pi", h).over(by_pair()) for h in horizons]
    ys = [a if target == "level" else F.log1p(a) - F.log1p("pi") for a in ahead]
    wide = panel.select("pair_id", "date", F.col("pi").alias("x"), *(y.alias(f"y{h}") for h, y in zip(horizons, ys, strict=True)))
    names = [c for f in families for c in FAMILIES[f]]
    if names:
        wide = wide.join(features.select("pair_id", "date", *names).hint("merge"), ["pair_id", "date"], "left")
    pairs = ", ".join(f"{h}, y{h}" for h in horizons)
    rows = wide.select("pair_id", "date", "x", *names, F.expr(f"stack({len(horizons)}, {pairs}) AS (h, y)")).dropna(subset=["x", "y", *names])
    rows = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds or ("",)))))
    own = Window.partitionBy(*KEYS)
    rows = rows.withColumn("rn", F.row_number().over(own.orderBy("date")) - 1).withColumn("n", F.count("*").over(own)).where(F.col("n") >= LEAST_ROWS)
    if seeds:
        order = F.md5(F.concat_ws("|", "seed", "pair_id", F.date_format("date", "yyyy-MM-dd")))
        dealt = rows.select(*KEYS, (F.row_number().over(own.orderBy(order)) - 1).alias("rn"), "y")
        rows = rows.drop("y").join(dealt.hint("merge"), [*KEYS, "rn"])
    rows = rows.withColumn("least", F.expr(f"n div {splits + 1}")).withColumn("fold", F.explode(F.expr(f"sequence(0, {splits - 1})")))
    edge = lambda k: F.expr(f"least + floor({k} * (n - least) / {splits}D)")
    rows = rows.withColumn("lo", edge("fold")).withColumn("hi", edge("(fold + 1)")).where(F.expr(f"lo - h >= {LEAST_TRAIN} and hi > lo"))
    first = F.lit(0) if cap is None else F.expr(f"lo - h - {cap}")
    role = F.when(F.expr("rn >= lo and rn < hi"), "test").when(F.expr("rn < lo - h") & (F.col("rn") >= first), "train")
    level = F.col("x") if target == "level" else F.lit(0.0)
    return rows.select(*KEYS, "fold", role.alias("role"), "rn", "date", "x", "y", level.alias("level"), *names).where("role is not null")


def _solved(sums: DataFrame, columns: list[str], arm: str, shrink: float) -> DataFrame:
    """``sums`` with the ridge slopes b_<arm>_<column>, by elimination over the columns' cross products."""
    k = len(columns)
    a = lambda i, j: f"e_{min(i, j)}_{max(i, j)}"
    cross = lambda i, j: F.col(f"c_{columns[i]}_{columns[j]}" if f"c_{columns[i]}_{columns[j]}" in sums.columns else f"c_{columns[j]}_{columns[i]}")
    kept = sums.columns
    made = {a(i, j): cross(i, j) + (F.lit(shrink) if i == j else F.lit(0.0)) for i in range(k) for j in range(i, k)} | {f"r_{i}": F.col(f"c_{columns[i]}_y") for i in range(k)}
    df = sums.select(*kept, *(v.alias(n) for n, v in made.items()))
    for p in range(k - 1):
        new = {}
        for i in range(p + 1, k):
            f = F.col(a(p, i)) / F.col(a(p, p))
            for j in range(i, k):
                new[a(i, j)] = F.col(a(i, j)) - f * F.col(a(p, j))
            new[f"r_{i}"] = F.col(f"r_{i}") - f * F.col(f"r_{p}")
        df = df.withColumns(new)
    for i in reversed(range(k)):
        rest = sum((F.col(a(i, j)) * F.col(f"b_{arm}_{columns[j]}") for j in range(i + 1, k)), F.lit(0.0))
        df = df.withColumn(f"b_{arm}_{columns[i]}", (F.col(f"r_{i}") - rest) / F.col(a(i, i)))
    return df.drop(*made)


def ridge_arms(frame: DataFrame, arms: dict[str, list[str]], shrink: float = SHRINK) -> DataFrame:
    """Out-of-fold predictions (KEYS, fold, date, arm, y, level, guess) of one ridge per arm, pair and fold, on the same rows.

    One aggregation gives each fold's means and cross products of all columns; every arm is solved from its part of them.
    ``arms`` names each arm's columns; x should be the first.
    """
    columns = list(dict.fromkeys(c for cs in arms.values() for c in cs))
    m = F.count("*")
    sums = [(F.covar_pop(c, d) * m).alias(f"c_{c}_{d}") for i, c in enumerate(columns) for d in columns[i:]] + [(F.covar_pop(c, "y") * m).alias(f"c_{c}_y") for c in columns]
    keys = [*KEYS, "fold"]
    fits = frame.where("role = 'train'").groupBy(*keys).agg(F.avg("y").alias("m_y"), *(F.avg(c).alias(f"m_{c}") for c in columns), *sums)
    for arm, cs in arms.items():
        fits = _solved(fits, cs, arm, shrink)
    slopes = [f"b_{arm}_{c}" for arm, cs in arms.items() for c in cs]
    test = frame.where("role = 'test'").join(fits.select(*keys, "m_y", *(f"m_{c}" for c in columns), *slopes).hint("merge"), keys)
    guess = lambda arm, cs: F.col("m_y") + sum(((F.col(c) - F.col(f"m_{c}")) * F.col(f"b_{arm}_{c}") for c in cs), F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(arm).alias("arm"), guess(arm, cs).alias("guess")) for arm, cs in arms.items())))
    return test.select(*keys, "date", "y", "level", each.alias("e")).select(*keys, "date", "y", "level", "e.arm", "e.guess")


def fold_scores(predictions: DataFrame, regime: Column, by: list[str]) -> DataFrame:
    """(by, regime, n, rmse, r2, hit_rate): by regime and pooled over all; the sign is that of the move from ``level``."""
    rows = predictions.withColumn("regime", regime).withColumn("e2", F.pow(F.col("y") - F.col("guess"), 2))
    move = F.when(F.col("y") != F.col("level"), (F.signum(F.col("y") - F.col("level")) == F.signum(F.col("guess") - F.col("level"))).cast("double"))
    both = rows.withColumn("regime", F.explode(F.array("regime", F.lit(POOLED))))
    total = F.var_pop("y") * F.count("*")
    return both.groupBy(*by, "regime").agg(F.count("*").alias("n"), F.sqrt(F.avg("e2")).alias("rmse"), (1 - F.sum("e2") / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(move).alias("hit_rate"))


def ablation(scores: DataFrame, base: str = "base") -> DataFrame:
    """Every arm against ``base`` by regime and horizon: n, d_rmse, d_r2; raises where two arms scored different samples."""
    plain = scores.where(F.col("arm") == base).select("h", "regime", F.col("n").alias("n_b"), F.col("rmse").alias("rmse_b"), F.col("r2").alias("r2_b"))
    both = scores.where(F.col("arm") != base).join(plain.hint("merge"), ["h", "regime"])
    same = F.when(F.col("n") == F.col("n_b"), F.col("n")).otherwise(F.raise_error(F.format_string("%s at %s: arms scored different samples", "arm", "h")).cast("long"))
    return both.select("h", "arm", "regime", same.alias("n"), (F.col("rmse") - F.col("rmse_b")).alias("d_rmse"), (F.col("r2") - F.col("r2_b")).alias("d_r2"))


def degenerate(deltas: DataFrame) -> DataFrame:
    """(arm, h) of families that help the smallest regime while they hurt the largest and the pooled rows; ties go by name."""
    size = F.struct("n", "regime")
    sides = deltas.groupBy("arm", "h").agg(
        F.max_by("d_r2", F.when(F.col("regime") != POOLED, size)).alias("dominant"), F.min_by("d_r2", F.when(F.col("regime") != POOLED, size)).alias("minority"), F.max(F.when(F.col("regime") == POOLED, F.col("d_r2"))).alias("pooled")
    )
    return sides.withColumn("degenerate", F.expr("minority > 0 and dominant < 0 and pooled < 0"))


def against_placebo(real: DataFrame, placebo: DataFrame, r2: float = 0.02, hit: float = 0.03) -> DataFrame:
    """Scores beside the mean of the placebo scores over seeds; ``leak`` where shuffled targets are still predicted."""
    mean = placebo.groupBy("h", "regime").agg(F.avg("r2").alias("placebo_r2"), F.avg("hit_rate").alias("placebo_hit"), F.count("*").alias("seeds"))
    both = real.select("h", "regime", "n", "r2", "hit_rate").join(mean.hint("merge"), ["h", "regime"])
    return both.withColumn("leak", (F.col("placebo_r2") > r2) | (F.abs(F.col("placebo_hit") - 0.5) > hit))


def leakage(frame: DataFrame) -> DataFrame:
    """Violations of a fold table by pair, horizon, seed and fold: rows that train and test, and training rows within h of the test block."""
    both = frame.groupBy(*KEYS, "fold", "rn").agg(F.count_distinct("role").alias("roles"))
    overlap = both.where("roles > 1").groupBy(*KEYS, "fold").agg(F.count("*").alias("n")).withColumn("rule", F.lit("overlap"))
    ends = frame.groupBy(*KEYS, "fold").agg(F.max(F.when(F.col("role") == "train", F.col("rn"))).alias("last"), F.min(F.when(F.col("role") == "test", F.col("rn"))).alias("first"))
    early = ends.where("last >= first - h").select(*KEYS, "fold", (F.col("last") - F.col("first") + F.col("h") + 1).cast("long").alias("n"), F.lit("embargo").alias("rule"))
    return overlap.unionByName(early)


def uniform(n: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from whole numbers, by three rounds of v * (2 v + 1) modulo 2**31 and a shift, so that SQL can make the same."""
    v = (n.astype(np.int64) * 40503 + salt) % (1 << 31)
    for _ in range(3):
        v = v * (2 * v + 1) % (1 << 31)
        v ^= v >> 15
    return (v + 0.5) / (1 << 31)


def draws(p: int, pair: str, fold: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal weights and uniform phases of ``p`` features, given by seed, pair, fold and p alone."""
    salt = (seed + int(hashlib.md5(pair.encode()).hexdigest()[:6], 16) + 7919 * fold + 104729 * p) % (1 << 31)
    j = 3 * np.arange(p)
    return np.sqrt(-2 * np.log(uniform(j, salt))) * np.cos(2 * np.pi * uniform(j + 1, salt)), 2 * np.pi * uniform(j + 2, salt)


def random_features(frame: DataFrame, features: list[int], shrinkages: list[float], seed: int = 20260729) -> DataFrame:
    """Predictions (KEYS, fold, date, y, level, p, shrinkage, guess) of a ridge on random Fourier features of x, by its dual.

    One group for each series, fold and number of features ``p`` of a fold table whose training blocks are capped: the kernel of
    its training rows is decomposed once and solved for every shrinkage, so the cost doesn't depend on whether p exceeds the rows.
    x is standardised by the training rows alone; their mean of y is taken off and added back.
    """
    keys = [*KEYS, "fold"]
    rows = frame.select(*keys, "role", "date", "x", "y", "level", F.explode(F.array(*map(F.lit, features))).alias("p"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        train, test = part[part["role"] == "train"], part[part["role"] == "test"]
        p = int(part["p"].iat[0])
        w, b = draws(p, str(part["pair_id"].iat[0]), int(part["fold"].iat[0]), seed)
        x, mean, spread = train["x"].to_numpy(), train["x"].mean(), train["x"].std(ddof=0) + 1e-12
        z, zt = (np.sqrt(2.0 / p) * np.cos(np.outer((v - mean) / spread, w) + b) for v in (x, test["x"].to_numpy()))
        y = train["y"].to_numpy()
        values, vectors = np.linalg.eigh(z @ z.T)
        turned, cross = vectors.T @ (y - y.mean()), zt @ z.T @ vectors
        out = [test[[*keys, "date", "y", "level", "p"]].assign(shrinkage=s, guess=cross @ (turned / (np.maximum(values, 0) + s)) + y.mean()) for s in shrinkages]
        return pd.concat(out)

    types = {"pair_id": "string", "h": "int", "seed": "string", "fold": "int", "date": "date", "y": "double", "level": "double", "p": "int", "shrinkage": "double", "guess": "double"}
    return rows.groupBy(*keys, "p").applyInPandas(fit, ", ".join(f"{n} {t}" for n, t in types.items()))
