"""Rolling, forward and fold windows over a pair's sessions, and estimators built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_pair():
    return Window.partitionBy("pair_id").orderBy("date")


def full_window(value: Column, n: int, least: int) -> Column:
    """``value`` where the trailing ``n`` rows hold at least ``least``, as a rolling minimum count asks."""
    w = by_pair().rowsBetween(-(n - 1), 0)
    return F.when(F.count("*").over(w) >= least, value)


def realised_volatility(panel: DataFrame, n: int, column: str = "adr") -> DataFrame:
    """Annualised deviation of daily log changes over the trailing ``n`` of them."""
    changes = panel.withColumn("r", F.ln(column) - F.lag(F.ln(column)).over(by_pair())).where("r is not null")
    w = by_pair().rowsBetween(-(n - 1), 0)
    return changes.withColumn("vol", full_window(F.stddev_samp("r").over(w) * F.sqrt(F.lit(252.0)), n, n))


def drawdown(panel: DataFrame, n: int, column: str = "pi") -> DataFrame:
    w = by_pair().rowsBetween(-(n - 1), 0)
    return panel.withColumn("drawdown", full_window(F.col(column) - F.max(column).over(w), n, n))


def trend(panel: DataFrame, k: int, column: str = "fx") -> DataFrame:
    return panel.withColumn("trend", F.col(column) / F.lag(column, k).over(by_pair()) - 1)


def trailing_rank(panel: DataFrame, n: int, least: int, column: str = "pi") -> DataFrame:
    """Share of the earlier values of the trailing window that the last one reaches (itself left out), and its tercile.

    The window is bounded, so the collected array is; it is counted in place by a higher-order function.
    """
    w = by_pair().rowsBetween(-(n - 1), 0)
    held = panel.withColumn("held", F.collect_list(column).over(w))
    rank = F.expr(f"(size(filter(held, v -> v <= {column})) - 1) / (size(held) - 1)")
    out = held.withColumn("rank", F.when(F.size("held") >= least, rank)).drop("held")
    return out.withColumn("state", F.when(F.col("rank") <= 1 / 3, "low").when(F.col("rank") <= 2 / 3, "normal").when(F.col("rank").isNotNull(), "tight"))


def forward(panel: DataFrame, h: int, column: str = "pi") -> DataFrame:
    """Value ``h`` sessions on, log change to it, and the largest value on the way; sessions without the full horizon drop."""
    ahead = F.lead(column, h).over(by_pair())
    out = panel.withColumn("target", ahead).withColumn("log_change", F.log1p(ahead) - F.log1p(column)).withColumn("peak", F.max(column).over(by_pair().rowsBetween(0, h)))
    return out.where("target is not null")


def margin_path(panel: DataFrame, notional: float, column: str = "pi") -> DataFrame:
    """Cumulative loss of a short premium position from the first session, floored at zero, and the running margin call."""
    step = F.coalesce(F.col(column) - F.lag(column).over(by_pair()), F.lit(0.0)) * notional
    running = by_pair().rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumn("step", step).withColumn("loss", F.greatest(F.sum("step").over(running), F.lit(0.0)))
    return out.withColumn("peak_call", F.max("loss").over(running))


def walk_forward(panel: DataFrame, splits: int, embargo: int) -> DataFrame:
    """Expanding folds (pair_id, date, fold, role): test blocks follow a first training part of n // (splits + 1) sessions;
    the ``embargo`` sessions before a test block are neither."""
    w = Window.partitionBy("pair_id")
    rows = panel.withColumn("rn", F.row_number().over(by_pair()) - 1).withColumn("n", F.count("*").over(w)).withColumn("least", F.expr(f"n div {splits + 1}"))
    edge = lambda k: f"(least + floor({k} * (n - least) / {splits}D))"
    folds = rows.select("*", F.explode(F.expr(f"sequence(1, {splits})")).alias("fold")).withColumn("lo", F.expr(edge("(fold - 1)"))).withColumn("hi", F.expr(edge("fold")))
    role = F.when((F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi")), "test").when(F.col("rn") < F.col("lo") - embargo, "train").when(F.col("rn") < F.col("lo"), "embargoed")
    return folds.withColumn("role", role).where("role is not null")


def fold_report(folds: DataFrame) -> DataFrame:
    return folds.groupBy("pair_id", "fold").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("train", "test", "embargoed")))


def ridge_predictions(folds: DataFrame, h: int, shrink: float, column: str = "pi") -> DataFrame:
    """One-feature ridge of the value ``h`` sessions on, fitted per pair and fold on centred training rows: test rows with x, y, guess.

    The fit is five sums per fold, joined back to the fold's test rows; no model leaves Spark.
    """
    w = Window.partitionBy("pair_id", "fold").orderBy("date")
    rows = folds.withColumn("y", F.lead(column, h).over(w)).withColumn("x", F.col(column))
    train = rows.where("role = 'train' and y is not null").groupBy("pair_id", "fold").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("cxx"), F.count("*").alias("m"))
    test = rows.where("role = 'test' and y is not null").join(train, ["pair_id", "fold"])
    return test.withColumn("guess", F.expr(f"my + (x - mx) * (cxy * m) / (cxx * m + {shrink})"))


def ridge_scores(folds: DataFrame, h: int, shrink: float, column: str = "pi") -> DataFrame:
    """Out-of-fold scores of ``ridge_predictions`` by pair."""
    test = ridge_predictions(folds, h, shrink, column)
    hit = F.when(F.col("y") != F.col("x"), (F.signum(F.col("guess") - F.col("x")) == F.signum(F.col("y") - F.col("x"))).cast("double"))
    return test.groupBy("pair_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("guess"), 2))).alias("rmse"), (1 - F.sum(F.pow(F.col("y") - F.col("guess"), 2)) / (F.var_pop("y") * F.count("*"))).alias("r2"), F.avg(hit).alias("sign_hit"))


def local_projection(panel: DataFrame, horizons: list[int], shrink: float = 1e-4, column: str = "pi") -> DataFrame:
    """Slope of the value h sessions on, per pair and horizon, after demeaning within the pair; pairs of rows come from an
    equi-join on the session number, so each horizon costs one row per session."""
    rows = panel.withColumn("rn", F.row_number().over(by_pair())).withColumn("x", F.col(column) - F.avg(column).over(Window.partitionBy("pair_id"))).select("pair_id", "rn", "x")
    now = rows.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("at", F.col("rn") + F.col("h")).select("pair_id", "h", "x", "at")
    both = now.join(rows.select("pair_id", F.col("rn").alias("at"), F.col("x").alias("y")), ["pair_id", "at"])
    sums = both.groupBy("pair_id", "h").agg(F.count("*").alias("n"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"), (F.var_pop("x") * F.count("*")).alias("sxx"), F.corr("x", "y").alias("r"))
    return sums.select("pair_id", "h", "n", (F.col("sxy") / (F.col("sxx") + shrink)).alias("rho"), (F.col("r") * F.col("r")).alias("r2"))


def non_overlapping(panel: DataFrame, h: int) -> DataFrame:
    return panel.withColumn("rn", F.row_number().over(by_pair()) - 1).where(f"rn % {h} = 0")


def calm_and_stress(panel: DataFrame, share: float = 0.8, column: str = "pi") -> DataFrame:
    """Mean absolute change on days below and above the pair's ``share`` percentile of absolute changes."""
    moves = panel.withColumn("m", F.abs(F.col(column) - F.lag(column).over(by_pair()))).where("m is not null")
    cut = moves.groupBy("pair_id").agg(F.expr(f"percentile(m, {share})").alias("cut"))
    out = moves.join(cut, "pair_id").withColumn("stress", F.col("m") > F.col("cut"))
    return out.groupBy("pair_id", "stress").agg(F.count("*").alias("n"), F.avg("m").alias("mean_move"))


def fx_regression(panel: DataFrame) -> DataFrame:
    """Slope of premium changes on FX changes by pair, its standard error and R squared, from regression sums."""
    d = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by_pair())
    rows = panel.select("pair_id", "date", d("fx").alias("x"), (F.col("pi") - F.lag("pi").over(by_pair())).alias("y")).where("x is not null and y is not null")
    sums = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r2"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    return sums.select("pair_id", "n", "beta", "r2", F.expr("sqrt((syy - beta * sxy) / (n - 2) / sxx)").alias("se"))


def expanding_percentile(panel: DataFrame, warm_up: int = 504, column: str = "pi") -> DataFrame:
    """Share of a pair's values so far, the last one included, that the last one reaches; null during the warm-up.

    The held array is bounded by the calendar: one value for each session of one pair.
    """
    w = by_pair().rowsBetween(Window.unboundedPreceding, 0)
    held = panel.withColumn("held", F.collect_list(column).over(w))
    return held.withColumn("percentile", F.when(F.size("held") >= warm_up, F.expr(f"size(filter(held, v -> v <= {column})) / size(held)"))).drop("held")


def relative_volume(panel: DataFrame, n: int = 63, least: int = 5) -> DataFrame:
    """Volume over its trailing mean."""
    w = by_pair().rowsBetween(-(n - 1), 0)
    return panel.withColumn("relative_volume", full_window(F.col("volume") / F.avg("volume").over(w), n, least))
