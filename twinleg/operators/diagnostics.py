"""What a forecast earns beyond mechanical sizing, and on which moves: two tracks on the same folds, by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinleg.session import cut_lineage

#: Rows of a block of consecutive places; a block also sees the rows of one kernel width before it.
BLOCK = 4096
#: A residual deviation below this share of the track's own is rounding.
EXACT = 1e-12
GROUP = ["regime", "seed"]
FOLD = ["pair_id", "h", "seed", "fold"]
SHARES = 10


def paired(frame: DataFrame, plain: DataFrame, rich: DataFrame, regime: Column) -> DataFrame:
    """(regime, pair_id, h, seed, fold, date, y, guess_a, guess_b, sigma): the two tracks' guesses for each test row of ``frame``.

    sigma is the deviation of the target over the fold's training rows alone; where they don't vary it is 1e-9.
    """
    spread = frame.where("role = 'train'").groupBy(*FOLD).agg(F.stddev_samp("y").alias("s"))
    spread = spread.select(*FOLD, F.when(F.col("s") > 0, F.col("s")).otherwise(1e-9).alias("sigma"))
    both = plain.select(*FOLD, "date", "y", F.col("guess").alias("guess_a")).join(rich.select(*FOLD, "date", F.col("guess").alias("guess_b")).hint("merge"), [*FOLD, "date"])
    return both.join(spread.hint("merge"), FOLD).select(regime.alias("regime"), "*")


def placed(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the place from 0 of a row in its regime and seed by pair, fold and date.

    Rows are numbered inside their pair; only the pairs' counts, a row each, are summed up in order.
    """
    own = Window.partitionBy("regime", "seed", "pair_id").orderBy("fold", "date")
    counts = rows.groupBy("regime", "seed", "pair_id").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*GROUP).orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("regime", "seed", "pair_id", before.alias("offset"))
    inner = rows.withColumn("own", F.row_number().over(own) - 1)
    return inner.join(offsets.hint("merge"), ["regime", "seed", "pair_id"]).withColumn("pos", F.col("offset") + F.col("own")).drop("offset", "own")


def kernel_sums(rows: DataFrame, columns: list[str], lag: int) -> DataFrame:
    """(regime, seed, lrv_<column>..., flips): Bartlett long-run variances of centred columns over the order of ``pos``, and the sum
    of the absolute changes of ``side`` from row to row.

    n times the variance is the sum of squares of all sums over lag + 1 neighbours, the ends padded with zeros, divided by
    lag + 1.  Places are cut into blocks that also hold the ``lag`` rows before them, so no task holds a whole regime.
    """
    lag = max(lag, 1)
    n = rows.groupBy(*GROUP).agg(F.count("*").alias("n"))
    pads = n.select(*GROUP, F.explode(F.sequence(F.col("n"), F.col("n") + lag - 1)).alias("pos"), *(F.lit(0.0).alias(c) for c in columns), F.lit(None).cast("double").alias("side"))
    cut = lambda p: F.floor(p / BLOCK).cast("long")
    spread = rows.select(*GROUP, "pos", *columns, "side").unionByName(pads)
    spread = spread.withColumn("block", F.explode(F.sequence(cut(F.col("pos")), cut(F.col("pos") + lag))))
    order = Window.partitionBy(*GROUP, "block").orderBy("pos")
    near = order.rangeBetween(-lag, 0)
    sums = spread.select(*GROUP, "pos", "block", *(F.sum(c).over(near).alias(c) for c in columns), F.abs(F.col("side") - F.lag("side").over(order)).alias("flip"))
    sums = sums.where(cut(F.col("pos")) == F.col("block"))
    out = sums.groupBy(*GROUP).agg(*(F.sum(F.col(c) * F.col(c)).alias(c) for c in columns), F.sum("flip").alias("flips"))
    return out.join(n.hint("merge"), GROUP).select(*GROUP, *(F.greatest(F.col(c) / (lag + 1) / F.col("n"), F.lit(1e-18)).alias(f"lrv_{c}") for c in columns), "flips")


def strategy_diagnostics(rows: DataFrame, h: int) -> DataFrame:
    """By regime and seed: the plain track (a), the rich one (b), always short, and always short sized by 1 / sigma.

    A position follows its forecast, so a gain is the sign of the guess times the change.  Sharpe ratios scale by
    sqrt(252 / h), as targets overlap.  alpha and load are the rich track's on the volatility-sized benchmark; alpha's t is given
    as if independent, with a Bartlett long-run variance of h - 1 lags (at least one), and on every h-th row.  Zero deviations give
    zero ratios; a benchmark that doesn't vary gives a null load, a track that is a multiple of it a zero alpha and zero t, sides or sigmas that don't a null correlation, one row no turnover.
    """
    side = F.signum("guess_b")
    pnl = {"a": F.signum("guess_a") * F.col("y"), "b": side * F.col("y"), "u": -F.col("y"), "v": -F.col("y") / F.col("sigma")}
    # every sum below reads these rows, so the tracks are solved once
    full = cut_lineage(placed(cut_lineage(rows)).select(*GROUP, "pos", *(c.alias(k) for k, c in pnl.items()), side.alias("side"), "sigma"))
    means = [f(k).alias(f"{p}_{k}") for k in pnl for p, f in (("m", F.avg), ("s", F.stddev_samp))]
    load = F.covar_pop("v", "b") / F.nullif(F.var_pop("v"), F.lit(0.0))
    sums = full.groupBy(*GROUP).agg(F.count("*").alias("n"), *means, load.alias("load"), F.try_divide(F.covar_pop("side", "sigma"), F.stddev_pop("side") * F.stddev_pop("sigma")).alias("corr_side_sigma"))
    sums = sums.withColumn("alpha", F.col("m_b") - F.col("load") * F.col("m_v"))
    # a row for each regime and seed
    own = full.join(F.broadcast(sums.select(*GROUP, "m_a", "m_b", "m_v", "load", "alpha")), GROUP)
    left = F.col("b") - F.col("load") * F.col("v")
    own = own.select(*GROUP, "pos", "side", (F.col("a") - F.col("m_a")).alias("a"), (F.col("b") - F.col("m_b")).alias("b"), (left - F.col("alpha")).alias("e"), left.alias("left"))
    kernel = kernel_sums(own, ["a", "b", "e"], h - 1)
    apart = F.when(F.col("pos") % h == 0, F.col("left"))
    blocks = own.groupBy(*GROUP).agg(F.stddev_samp("left").alias("s_left"), F.count(apart).alias("blocks"), F.avg(apart).alias("m_apart"), F.stddev_samp(apart).alias("s_apart"))
    out = sums.join(kernel.hint("merge"), GROUP).join(blocks.hint("merge"), GROUP)
    # what is left of a multiple of the benchmark is rounding
    same = F.col("s_left") <= EXACT * F.col("s_b")
    out = out.withColumns({"alpha": F.when(same, 0.0).otherwise(F.col("alpha")), "m_apart": F.when(same, 0.0).otherwise(F.col("m_apart"))})
    ratio = lambda m, s, scale: F.coalesce(F.try_divide(F.col(m), F.when(F.col(s) > 0, F.col(s))), F.lit(0.0)) * scale
    root, year = F.sqrt("n"), F.sqrt(F.lit(252.0 / h))
    hac = lambda m, c: F.col(m) / F.sqrt(F.col(f"lrv_{c}") / F.col("n"))
    return out.select(
        *GROUP, "n", *(ratio(f"m_{k}", f"s_{k}", year).alias(f"sharpe_{name}") for k, name in (("a", "a"), ("b", "b"), ("u", "short"), ("v", "vol_managed"))),
        "alpha", "load", ratio("alpha", "s_left", root).alias("t_alpha_naive"), hac("alpha", "e").alias("t_alpha_hac"),
        F.when(F.col("blocks") > 2, ratio("m_apart", "s_apart", F.sqrt("blocks"))).otherwise(0.0).alias("t_alpha_apart"), "blocks",
        hac("m_a", "a").alias("t_a_hac"), hac("m_b", "b").alias("t_b_hac"), "corr_side_sigma", (F.try_divide("flips", F.col("n") - 1) / 2).alias("turnover"))


def magnitude_shares(rows: DataFrame, parts: int = SHARES) -> DataFrame:
    """By regime, seed, track and tenth of the size of the change: mean size, hits, share of all gains and losses, mean gain, rows.

    Edges are exact quantiles, equal ones count once and a tenth is open below, so ties stay together and there may be fewer
    tenths.  The share is signed: a tenth that loses is negative.
    """
    size, rows = F.abs("y"), cut_lineage(rows)
    cuts = ", ".join(f"{i}D / {parts}" for i in range(parts + 1))
    edges = rows.withColumn("size", size).groupBy(*GROUP).agg(F.expr(f"array_distinct(percentile(size, array({cuts})))").alias("edges"))
    # a row for each regime and seed
    cut = rows.withColumn("size", size).join(F.broadcast(edges), GROUP)
    cut = cut.withColumn("tenth", F.greatest(F.size(F.filter("edges", lambda e: e < F.col("size"))), F.lit(1)))
    tracks = F.explode(F.array(*(F.struct(F.lit(t).alias("track"), F.signum(f"guess_{t}").alias("side")) for t in "ab")))
    each = cut.select(*GROUP, "tenth", "size", "y", tracks.alias("x")).select(*GROUP, "tenth", "size", "x.track", (F.col("x.side") * F.col("y")).alias("gain"), (F.col("x.side") == F.signum("y")).cast("double").alias("hit"))
    out = each.groupBy(*GROUP, "track", "tenth").agg(F.avg("size").alias("mean_size"), F.avg("hit").alias("hit_rate"), F.sum("gain").alias("gains"), F.sum(F.abs("gain")).alias("gross"), F.avg("gain").alias("mean_gain"), F.count("*").alias("n"))
    whole = F.sum("gross").over(Window.partitionBy(*GROUP, "track"))
    return out.select(*GROUP, "track", "tenth", "mean_size", "hit_rate", (F.col("gains") / F.nullif(whole, F.lit(0.0))).alias("gain_share"), "mean_gain", "n")
