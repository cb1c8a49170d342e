"""Errors, half-lives, tests and samples for the persistence of a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_pair


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, to about 1e-7, as a column expression."""
    # A published rational approximation of the error function.
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = F.lit(0.0)
    for c in reversed(a):
        series = (series + c) * t
    return series * F.exp(-x * x)


def projections(panel: DataFrame, horizons: list[int], shrink: float = 1e-4, column: str = "pi") -> DataFrame:
    """Slope of the value h sessions on, its Bartlett-kernel error and the sessions used, per pair and horizon.

    The kernel's lag sums equal the squares of a rolling sum over h + 1 rows of the scores, padded with h zeros, so one window
    takes the place of a loop over lags; the order key is scaled by h + 1, which makes one range frame fit all horizons.
    """
    rows = panel.withColumn("rn", F.row_number().over(by_pair())).withColumn("x", F.col(column) - F.avg(column).over(Window.partitionBy("pair_id"))).select("pair_id", "rn", "x")
    now = rows.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("at", F.col("rn") + F.col("h"))
    both = now.join(rows.select("pair_id", F.col("rn").alias("at"), F.col("x").alias("y")).hint("shuffle_hash"), ["pair_id", "at"])
    sums = both.groupBy("pair_id", "h").agg(F.count("*").alias("n"), F.max("rn").alias("last"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"), (F.var_pop("x") * F.count("*")).alias("sxx"))
    sums = sums.withColumn("rho", F.col("sxy") / (F.col("sxx") + shrink))
    scores = both.join(sums.hint("merge"), ["pair_id", "h"]).select("pair_id", "h", "rn", F.expr("(x - mx) * (y - my - rho * (x - mx)) AS u"))
    padding = sums.select("pair_id", "h", F.explode(F.expr("sequence(last + 1, last + h)")).alias("rn"), F.lit(0.0).alias("u"))
    rolled = scores.unionByName(padding).withColumn("s", F.expr("sum(u) over (partition by pair_id, h order by rn / (h + 1.0D) range between 0.999999D preceding and current row)"))
    meat = rolled.groupBy("pair_id", "h").agg((F.sum(F.col("s") * F.col("s")) / (F.first("h") + 1)).alias("meat"))
    return sums.join(meat.hint("merge"), ["pair_id", "h"]).select("pair_id", "h", "n", "rho", F.try_divide(F.sqrt("meat"), F.col("sxx")).alias("se"))


def half_lives(path: DataFrame, identified: float) -> DataFrame:
    """First passage of the path below one half by pair, its 95 % band, and how well the sample supports it.

    An open upper end is ``unbounded_above``, not a missing value.  A path that stays above one half is extrapolated by an
    exponential fit over its positive slopes, of which three are needed.
    """
    w = Window.partitionBy("pair_id").orderBy("h")
    rows = path.select("pair_id", "h", "rho", (F.col("rho") - 1.96 * F.col("se")).alias("lo"), (F.col("rho") + 1.96 * F.col("se")).alias("hi"), (F.col("n") / F.col("h")).alias("spans"))
    nexts = rows.select("*", *(F.lead(c).over(w).alias(f"{c}1") for c in ("h", "rho", "lo", "hi", "spans")))
    cross = lambda c, out: F.min_by(F.when((F.col(c) >= 0.5) & (F.col(f"{c}1") < 0.5), out(c)), F.when((F.col(c) >= 0.5) & (F.col(f"{c}1") < 0.5), F.col("h")))
    part = lambda c: (F.col(c) - 0.5) / (F.col(c) - F.col(f"{c}1"))
    at = lambda c: F.col("h") + part(c) * (F.col("h1") - F.col("h"))
    g = nexts.groupBy("pair_id").agg(
        F.count("*").alias("fits"), F.min("h").alias("h0"), *(F.min_by(c, "h").alias(f"first_{c}") for c in ("rho", "hi")),
        cross("rho", at).alias("point"), cross("lo", at).alias("lower"), cross("hi", at).alias("upper"), cross("rho", lambda c: F.col("spans") + part(c) * (F.col("spans1") - F.col("spans"))).alias("spans_at"),
        F.count_if(F.col("rho") > 1e-6).alias("positive"), F.regr_slope(F.when(F.col("rho") > 1e-6, F.ln("rho")), F.when(F.col("rho") > 1e-6, F.col("h").cast("double"))).alias("slope"),
    )
    sub, found, fits = F.col("first_rho") < 0.5, F.col("point").isNotNull(), (F.col("positive") >= 3) & (F.col("slope") < 0)
    few = F.col("fits") < 3
    support = F.when(few, "none").when(sub, "sub_resolution").when(found, F.when(F.col("spans_at") >= identified, "interpolated").otherwise("interpolated_underpowered")).when(fits, "extrapolated").otherwise("none")
    point = F.when(few, None).when(sub, F.col("h0").cast("double")).when(found, F.col("point")).when(fits, -F.ln(F.lit(2.0)) / F.col("slope"))
    lower = F.when(few, None).when(sub, F.lit(0.0)).otherwise(F.col("lower"))
    upper = F.when(few, None).when(sub, F.when(F.col("first_hi") < 0.5, F.col("h0").cast("double"))).otherwise(F.col("upper"))
    return g.select("pair_id", support.alias("support"), point.alias("point"), lower.alias("lower"), upper.alias("upper")).withColumn("unbounded_above", F.col("upper").isNull() & (F.col("support") != "none"))


def purged_folds(panel: DataFrame, splits: int, horizon: int, embargo: int) -> DataFrame:
    """(pair_id, date, fold, role): near-equal consecutive test blocks; rows whose label window meets the block are purged and
    the ``embargo`` rows after it are embargoed, all others train."""
    w = Window.partitionBy("pair_id")
    rows = panel.withColumn("i", F.row_number().over(by_pair()) - 1).withColumn("n", F.count("*").over(w))
    folds = rows.withColumn("fold", F.explode(F.expr(f"sequence(0, {splits - 1})")))
    start = lambda k: f"({k} * (n div {splits}) + least({k}, n % {splits}))"
    folds = folds.withColumn("a", F.expr(start("fold"))).withColumn("b", F.expr(start("(fold + 1)")) - 1).where("a <= b")
    role = F.when(F.expr("i between a and b"), "test").when(F.expr(f"i < a and i + {horizon - 1} >= a"), "purged").when(F.expr(f"i > b and i <= b + {embargo}"), "embargoed").otherwise("train")
    return folds.select("pair_id", "date", "fold", role.alias("role"))


def placebo(panel: DataFrame, seed: str, column: str = "pi") -> DataFrame:
    """``column`` dealt anew among the sessions of each pair, in an order given by a digest of seed, pair and session."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "pair_id", F.date_format("date", "yyyy-MM-dd")))
    rows = panel.select("pair_id", "date", column, F.row_number().over(by_pair()).alias("rn"), F.row_number().over(Window.partitionBy("pair_id").orderBy(key)).alias("dealt"))
    return rows.select("pair_id", "date", "rn").join(rows.select("pair_id", F.col("dealt").alias("rn"), F.col(column).alias("placebo")), ["pair_id", "rn"]).drop("rn")


def long_run_t(panel: DataFrame, h: int, column: str = "pi") -> DataFrame:
    """t of the mean h-session change three ways: as if independent, with a Bartlett long-run variance, and on every h-th row."""
    rows = panel.withColumn("rn", F.row_number().over(by_pair()) - 1).withColumn("y", F.lead(column, h).over(by_pair()) - F.col(column)).where("y is not null")
    centred = rows.withColumn("u", F.col("y") - F.avg("y").over(Window.partitionBy("pair_id"))).select("pair_id", "rn", "y", "u")
    padding = centred.groupBy("pair_id").agg(F.max("rn").alias("last")).select("pair_id", F.explode(F.expr(f"sequence(last + 1, last + {h})")).alias("rn"), F.lit(None).cast("double").alias("y"), F.lit(0.0).alias("u"))
    rolled = centred.unionByName(padding).withColumn("s", F.sum("u").over(Window.partitionBy("pair_id").orderBy("rn").rowsBetween(-h, 0)))
    block = F.when(F.col("rn") % h == 0, F.col("y"))
    t = lambda sd, n: F.try_divide(F.avg("y"), F.try_divide(sd, F.sqrt(n)))
    return rolled.groupBy("pair_id").agg(
        F.count("y").alias("n"), F.count(block).alias("blocks"), t(F.stddev_samp("y"), F.count("y")).alias("t_naive"),
        t(F.sqrt(F.try_divide(F.sum(F.col("s") * F.col("s")) / (h + 1), F.count("y"))), F.count("y")).alias("t_hac"),
        F.try_divide(F.avg(block), F.try_divide(F.stddev_samp(block), F.sqrt(F.count(block)))).alias("t_blocks"),
    )


def two_proportions(cells: DataFrame) -> DataFrame:
    """Pooled z test of cells(key, k1, n1, k2, n2): both shares, their gap in points, z and its two-sided tail."""
    pool = F.expr("try_divide(k1 + k2, n1 + n2)")
    out = cells.withColumn("p1", F.expr("try_divide(k1, n1)")).withColumn("p2", F.expr("try_divide(k2, n2)")).withColumn("se", F.sqrt(pool * (1 - pool) * F.expr("try_divide(1, n1) + try_divide(1, n2)")))
    out = out.withColumn("z", F.when(F.col("se") > 0, (F.col("p1") - F.col("p2")) / F.col("se"))).withColumn("p", normal_tail(F.col("z")))
    held = ((F.col("p1") - F.col("p2")) * 100 >= 10) & (F.col("p") < 0.05)
    return out.withColumn("verdict", F.when((F.col("n1") < 10) | (F.col("n2") < 10), "UNTESTABLE").when(held, "HELD").otherwise("NULL")).drop("se")


def mantel_haenszel(tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled odds ratio and continuity-corrected chi-square over strata(a, b, c, d), for each ``by``; empty strata don't count."""
    by = by or []
    s = tables.withColumn("n", F.expr("cast(a + b + c + d as double)")).where("n > 0")
    s = s.groupBy(*by).agg(F.sum(F.expr("a * d / n")).alias("up"), F.sum(F.expr("b * c / n")).alias("down"), F.sum("a").alias("seen"), F.sum(F.expr("(a + b) * (a + c) / n")).alias("expected"), F.sum(F.expr("if(n > 1, (a + b) / n * (c + d) / n * (a + c) * (b + d) / (n - 1), 0)")).alias("var"), F.count("*").alias("strata"))
    chi = F.when((F.col("down") > 0) & (F.col("var") > 0), F.pow(F.abs(F.col("seen") - F.col("expected")) - 0.5, 2) / F.col("var"))
    return s.select(*by, "strata", F.when(chi.isNotNull(), F.col("up") / F.col("down")).alias("odds_ratio"), chi.alias("chi2"), normal_tail(F.sqrt(chi)).alias("p"))
