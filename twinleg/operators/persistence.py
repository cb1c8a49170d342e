"""Persistence of a gap pooled over classes of pairs: the whole path with kernel errors, half-lives, metrics and gaps of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinleg.session import cut_lineage

from .inference import half_lives
from .series import by_pair

#: Rows of a block of consecutive places in a class; a block also sees the rows of one kernel width before it.
BLOCK = 4096
#: Label of the row over all classes, and independent spans from which a slope counts as identified (fixed values).
POOLED, SPANS = "POOLED", 12.0


def pooled_path(panel: DataFrame, regime: Column, horizons: list[int], shrink: float = 1e-4, least: float = 5.0, rows_least: int = 20, pool: bool = True) -> DataFrame:
    """AGG-12: (regime, h, pairs, n, rho, alpha, r2, se, t, spans, identified) by class, and over all of them as POOLED.

    Gaps are demeaned within the pair, then a class's pairs are stacked by name.  The error of the slope has Bartlett weights over h
    lags of the stacked rows, so those at a seam of two pairs count as neighbours.  Horizons under ``rows_least`` rows are left out;
    a class's path ends at the first with fewer than ``least`` rows for each step ahead.  Pairs without a class take no part, null
    gaps neither.  Where the gap doesn't vary r2, error and t are null.
    """
    mine = Window.partitionBy("pair_id")
    rows = panel.where("pi is not null").withColumn("regime", regime).where("regime is not null")
    rows = rows.withColumn("x", F.col("pi") - F.avg("pi").over(mine)).withColumn("own", F.row_number().over(by_pair()) - 1)
    ahead = F.array(*(F.lead("x", h).over(by_pair()) for h in horizons))
    rows = cut_lineage(rows.select("pair_id", "regime", "x", "own", ahead.alias("ahead")))
    groups = F.array(*([F.col("regime"), F.lit(POOLED)] if pool else [F.col("regime")]))

    n = F.count("*")
    flat = rows.select("x", "regime", F.posexplode("ahead").alias("i", "y")).where("y is not null")
    by_class = flat.withColumn("regime", F.explode(groups)).groupBy("regime", "i").agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"))
    by_class = by_class.withColumn("h", F.element_at(F.array(*map(F.lit, horizons)), F.col("i") + 1)).where(f"n >= {rows_least}")
    path = Window.partitionBy("regime").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    fits = by_class.withColumn("room", F.min(F.col("n") / F.col("h")).over(path)).where(f"room >= {least}").withColumn("rho", F.expr(f"sxy / (sxx + {shrink})"))
    fits = cut_lineage(fits.select("regime", "i", "h", "n", "mx", "my", "sxx", "rho", F.expr("my - rho * mx").alias("alpha"), (1 - F.expr("syy - 2 * rho * sxy + rho * rho * sxx") / F.nullif("syy", F.lit(0.0))).alias("r2")))

    # where each pair's rows begin in its class, at every horizon; one row a pair with its fits in an array
    counts = rows.groupBy("pair_id", "regime").agg(n.alias("k")).select("pair_id", F.explode(groups).alias("regime"), "k")
    stacked = counts.join(fits.hint("merge"), "regime").withColumn("left", F.greatest(F.col("k") - F.col("h"), F.lit(0)))
    before = F.sum("left").over(Window.partitionBy("regime", "h").orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = stacked.withColumn("start", F.coalesce(before, F.lit(0)))
    pairs = counts.groupBy("regime").agg(n.alias("pairs"))
    plans = starts.groupBy("pair_id").agg(F.collect_list(F.struct("regime", "i", "h", "n", "start", "mx", "my", "rho")).alias("plan"))
    scores = rows.join(plans.hint("merge"), "pair_id").select("own", "x", "ahead", F.explode("plan").alias("p")).withColumn("y", F.col("ahead")[F.col("p.i")]).where("y is not null")
    scores = scores.select("p.regime", "p.h", (F.col("p.start") + F.col("own")).alias("pos"), ((F.col("x") - F.col("p.mx")) * (F.col("y") - F.col("p.my") - F.col("p.rho") * (F.col("x") - F.col("p.mx")))).alias("u"))
    out = fits.join(_meat(scores, fits).hint("merge"), ["regime", "h"], "left").join(pairs.hint("merge"), "regime").withColumn("se", F.sqrt("meat") / F.nullif("sxx", F.lit(0.0)))
    spans = F.col("n") / F.col("h")
    return out.select("regime", "h", "pairs", "n", "rho", "alpha", "r2", "se", F.try_divide("rho", "se").alias("t"), spans.alias("spans"), (spans >= SPANS).alias("identified"))


def _meat(scores: DataFrame, fits: DataFrame) -> DataFrame:
    """(regime, h, meat): Bartlett-weighted sums of products of the scores up to h places apart.

    They equal the squares of all sums over h + 1 neighbours, the end padded with h zeros, divided by h + 1.  Places are cut into
    blocks that also hold the h rows before them, so no task holds a class; within a block places are scaled by h + 1, which makes
    one range frame fit all horizons.
    """
    pads = fits.select("regime", "h", F.explode(F.expr("sequence(n, n + h - 1)")).alias("pos"), F.lit(0.0).alias("u"))
    cut = lambda p: F.floor(p / BLOCK).cast("long")
    rows = scores.unionByName(pads).withColumn("block", F.explode(F.sequence(cut(F.col("pos")), cut(F.col("pos") + F.col("h")))))
    rows = rows.withColumn("at", (F.col("pos") - F.col("block") * BLOCK) / (F.col("h") + 1.0))
    rolled = rows.withColumn("s", F.expr("sum(u) over (partition by regime, h, block order by at range between 0.999999D preceding and current row)"))
    return rolled.where(cut(F.col("pos")) == F.col("block")).groupBy("regime", "h").agg((F.sum(F.col("s") * F.col("s")) / (F.col("h") + 1)).alias("meat"))


def regime_half_lives(path: DataFrame) -> DataFrame:
    """AGG-14: half-life, band and support of every class of ``pooled_path``."""
    return half_lives(path.withColumnRenamed("regime", "pair_id"), SPANS).withColumnRenamed("pair_id", "regime")


def metrics(path: DataFrame, horizons: list[int]) -> DataFrame:
    """AGG-16, TOP-05: the chosen horizons of every class beside its half-life, numbered by ``place``: classes by name, then horizons,
    the pooled rows last.  A class without a fit at a horizon has no row there."""
    wanted = path.where(F.col("h").isin(horizons)).join(regime_half_lives(path).hint("merge"), "regime")
    rows = wanted.select("regime", "pairs", "n", "h", "rho", "t", "r2", "spans", F.col("point").alias("half_life"), F.col("lower").alias("half_life_lo"), F.col("upper").alias("half_life_hi"), "unbounded_above", "support")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("regime") == POOLED, "regime", "h")))


def class_gaps(panel: DataFrame, regime: Column, slow: str, fast: str, horizons: list[int]) -> DataFrame:
    """AGG-51: whether class ``slow`` differs from ``fast`` by more than the size of its gaps, in one row.

    ``level_gap`` is the least mean size of a slow pair's gap over the largest of a fast one, ``dynamics_gap`` the same of half-lives,
    pairs below one step (sub_resolution) left out of it.  ``informative`` says that the second is over twice the first; null where
    a side has no pair left.
    """
    lives = regime_half_lives(pooled_path(panel, F.col("pair_id"), horizons, pool=False)).withColumnRenamed("regime", "pair_id")
    level = panel.withColumn("regime", regime).where(F.col("regime").isin(slow, fast)).groupBy("pair_id", "regime").agg(F.abs(F.avg("pi")).alias("level"))
    rows = level.join(lives.select("pair_id", "support", "point").hint("merge"), "pair_id", "left").withColumn("life", F.when(F.col("support") != "sub_resolution", F.col("point")))
    side = lambda f, r, c: f(F.when(F.col("regime") == r, F.col(c)))
    ratio = lambda c: F.try_divide(side(F.min, slow, c), side(F.max, fast, c))
    out = rows.agg(side(F.count, slow, "level").alias("slow_pairs"), side(F.count, fast, "level").alias("fast_pairs"), side(F.count, slow, "life").alias("slow_lives"), side(F.count, fast, "life").alias("fast_lives"), ratio("level").alias("level_gap"), ratio("life").alias("dynamics_gap"))
    return out.withColumn("informative", F.col("dynamics_gap") > 2 * F.col("level_gap"))
