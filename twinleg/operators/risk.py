"""Risk of a pair against its legs, capacity to leave it, and sizes that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_pair

# One-tailed 95 % point of the normal distribution, sessions a year.
VAR_Z, YEAR = 1.645, 252.0


def leg_returns(panel: DataFrame) -> DataFrame:
    """Daily log changes of the receipt (ra), the local share in dollars (rl) and the gap (rp); a pair's first session has none."""
    d = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by_pair())
    rows = panel.withColumn("usd", F.col("local") / F.col("fx")).withColumn("gap", 1 + F.col("pi"))
    return rows.select("pair_id", "date", "pi", d("adr").alias("ra"), d("usd").alias("rl"), d("gap").alias("rp"), d("local").alias("rlocal"), d("fx").alias("rfx"))


def return_variance(panel: DataFrame) -> DataFrame:
    """The receipt's variance split by r_adr = local - fx + gap: shares of variances and signed covariances, which sum to one.

    ``descriptive`` marks pairs of fewer than 30 changes, ``absorbing`` those whose gap absorbs local moves.
    """
    names = {"local": "rlocal", "fx": "rfx", "gap": "rp"}
    crossed = [("local", "fx", -2), ("local", "gap", 2), ("fx", "gap", -2)]
    sums = leg_returns(panel).where("ra is not null").groupBy("pair_id").agg(F.count("*").alias("n"), F.var_samp("ra").alias("total"), *(F.var_samp(c).alias(k) for k, c in names.items()), *(F.covar_samp(names[a], names[b]).alias(f"{a}_{b}") for a, b, _ in crossed))
    rebuilt = F.expr("local + fx + gap - 2 * local_fx + 2 * local_gap - 2 * fx_gap")
    shares = [(F.col(k) / F.col("total")).alias(f"share_{k}") for k in names] + [(sign * F.col(f"{a}_{b}") / F.col("total")).alias(f"share_{a}_{b}") for a, b, sign in crossed]
    return sums.select("pair_id", "n", F.col("total").alias("var_adr"), *shares, F.abs(F.col("total") - rebuilt).alias("residual"), (F.col("n") < 30).alias("descriptive"), F.expr("local_gap < -0.25 * gap").alias("absorbing"))


def stress_volatility(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """Annualised volatilities of both legs and of the pair on calm and stress days, and what netting saves.

    Stress days are those whose absolute change of the gap lies above the pair's own ``share`` quantile.
    """
    rows = leg_returns(panel).where("rp is not null")
    cut = rows.groupBy("pair_id").agg(F.expr(f"percentile(abs(rp), {share})").alias("cut"))
    vol = lambda c: F.stddev_samp(c) * F.sqrt(F.lit(YEAR))
    out = rows.join(cut, "pair_id").groupBy("pair_id", (F.abs("rp") > F.col("cut")).alias("stress")).agg(F.count("*").alias("n"), vol("ra").alias("vol_adr"), vol("rl").alias("vol_local"), vol("rp").alias("vol_pair"))
    return out.withColumn("ratio", F.expr("vol_pair / nullif(vol_adr + vol_local, 0)"))


def margin_calls(panel: DataFrame) -> DataFrame:
    """Day by day, as a share of the notional: cumulative loss of the short-gap pair and of two standalone tickets, floored at
    zero, plus the initial margin of each; the first session has no change."""
    every, running = Window.partitionBy("pair_id"), by_pair().rowsBetween(Window.unboundedPreceding, 0)
    margin = lambda c: VAR_Z * F.stddev_samp(c).over(every)
    rows = leg_returns(panel).withColumn("im_pair", margin("rp")).withColumn("im_standalone", margin("ra") + margin("rl"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    loss = lambda c: F.greatest(F.sum(c).over(running), F.lit(0.0))
    return rows.select("pair_id", "date", "pi", (F.col("im_pair") + loss(zero("rp"))).alias("total_pair"), (F.col("im_standalone") + loss(zero("ra") - zero("rl"))).alias("total_standalone"))


def peak_calls(calls: DataFrame, notionals: list[float]) -> DataFrame:
    """Largest call of each pair at each notional, netted and standalone, with the gap at the start and its peak."""
    peaks = calls.groupBy("pair_id").agg(F.count("*").alias("sessions"), F.min_by("pi", "date").alias("start_pi"), F.max("pi").alias("peak_pi"), F.max("total_pair").alias("pair"), F.max("total_standalone").alias("standalone"))
    rows = peaks.withColumn("notional", F.explode(F.array(*map(F.lit, notionals))))
    return rows.select("pair_id", "notional", "sessions", "start_pi", "peak_pi", (F.col("pair") * F.col("notional")).alias("pair_usd"), (F.col("standalone") * F.col("notional")).alias("standalone_usd"), (F.col("pair") / F.col("standalone")).alias("pair_vs_standalone"))


def stress_liquidity(bars: DataFrame, window: int = 63, least: int = 5) -> DataFrame:
    """Per series its widest session (the first of equal ones) against the median range, and that session's volume over its
    trailing mean, which looks at no later session."""
    w = Window.partitionBy("pair_id", "leg").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = bars.withColumn("range", (F.col("high") - F.col("low")) / F.col("close") * 100).withColumn("relative", F.when(F.count("volume").over(w) >= least, F.col("volume") / F.avg("volume").over(w)))
    top = F.max_by(F.struct("date", "range", "relative"), F.struct("range", (-F.unix_date("date")).alias("early")))
    out = rows.groupBy("pair_id", "leg").agg(F.count("*").alias("n"), F.expr("percentile(range, 0.5)").alias("median_range"), top.alias("t"))
    return out.select("pair_id", "leg", "n", F.col("t.date").alias("stress_date"), F.col("t.range").alias("stress_range"), "median_range", F.expr("t.range / nullif(median_range, 0)").alias("range_multiple"), F.col("t.relative").alias("volume_vs_trailing"))


def residual_share(panel: DataFrame) -> DataFrame:
    """Distribution of pi / (1 + pi), the part of the receipt's notional that a hedge of the local leg leaves open."""
    rows = panel.withColumn("r", F.col("pi") / (1 + F.col("pi")))
    return rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.expr("percentile(r, 0.5)").alias("median_share"), F.expr("percentile(r, 0.95)").alias("p95_share"), F.max("r").alias("max_share"))


def dollar_volume(bars: DataFrame, fx: DataFrame, n: int = 20, least: int = 3) -> DataFrame:
    """(pair_id, leg, date, adv): trailing mean of each leg's own close times its own volume in dollars, where ``least`` of the
    last ``n`` sessions have one.  Receipts (leg A) are in dollars; local shares (N) go through FX, carried forward over the
    leg's own sessions without a quote."""
    rows = bars.where("leg in ('A', 'N')").join(fx.hint("merge"), "date", "left")
    own = Window.partitionBy("pair_id", "leg").orderBy("date")
    carried = F.last("fx", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("usd", F.col("close") * F.col("volume") / F.when(F.col("leg") == "N", carried).otherwise(F.lit(1.0)))
    w = own.rowsBetween(-(n - 1), 0)
    return rows.withColumn("adv", F.when(F.count("usd").over(w) >= least, F.avg("usd").over(w))).where("adv is not null").select("pair_id", "leg", "date", "adv")


def dollar_adv(bars: DataFrame, fx: DataFrame, n: int = 20, least: int = 3) -> DataFrame:
    """The last of each leg's ``dollar_volume``, its first and last date, and whether its history is recent or deep."""
    out = dollar_volume(bars, fx, n, least).groupBy("pair_id", "leg")
    out = out.agg(F.count("adv").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("adv", "date").alias("adv"))
    return out.withColumn("caveat", F.when(F.col("n") < 60, "recent").otherwise("deep"))


def days_to_unwind(adv: DataFrame, sizes: list[float], participation_bp: list[int]) -> DataFrame:
    """Sessions to leave each size at each participation (in basis points of volume), by leg, and the leg that binds."""
    sides = adv.groupBy("pair_id").agg(*(F.max(F.when(F.col("leg") == k, F.col("adv"))).alias(k) for k in "AN"))
    grid = sides.withColumn("size_usd", F.explode(F.array(*map(F.lit, sizes)))).withColumn("participation_bp", F.explode(F.array(*map(F.lit, participation_bp))))
    days = lambda k: F.col("size_usd") / (F.col(k) * F.col("participation_bp") / 10000)
    out = grid.select("pair_id", "size_usd", "participation_bp", days("A").alias("days_adr"), days("N").alias("days_local"))
    return out.withColumn("days_binding", F.greatest("days_adr", "days_local")).withColumn("binding_leg", F.when(F.col("days_adr") >= F.col("days_local"), "adr").otherwise("local"))


def unwind_table(adv: DataFrame, sizes: list[float], participation_bp: list[int], stress: int = 10) -> DataFrame:
    """Normal and stressed sessions to leave: under stress the same share of volume is ``stress`` times harder to take."""
    normal = days_to_unwind(adv, sizes, participation_bp).select("pair_id", "size_usd", "participation_bp", F.col("days_binding").alias("sessions_normal"))
    return normal.withColumn("sessions_stressed", F.col("sessions_normal") * stress)


def excursion_axis(panel: DataFrame, h: int) -> DataFrame:
    """Adverse excursions (largest gap over the next ``h`` sessions less the gap, in points): median, 95th percentile, largest."""
    ahead = F.max("pi").over(by_pair().rowsBetween(0, h))
    rows = panel.withColumn("x", (ahead - F.col("pi")) * 100).withColumn("whole", F.lead("pi", h).over(by_pair())).where("whole is not null")
    sums = rows.groupBy("pair_id").agg(F.expr("percentile(x, 0.5)").alias("p50"), F.expr("percentile(x, 0.95)").alias("p95"), F.max("x").alias("worst"))
    return sums.selectExpr("pair_id", "stack(3, 'P50', p50, 'P95', p95, 'max', worst) as (excursion, points)")


def drawdown_budget(axis: DataFrame, budgets: list[float]) -> DataFrame:
    """Largest position, in multiples of risk capital, whose excursion fits each budget (percent); an error at or below zero."""
    points = F.when(F.col("points") > 0, F.col("points")).otherwise(F.raise_error(F.lit("excursion must be positive")))
    return axis.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("max_notional", F.col("budget") / points)


def reconcile_hints(report: DataFrame) -> DataFrame:
    """Likely causes of each disagreement that ``premium.reconcile`` reports, as codes in the order they are met."""
    share = F.col("mismatches") / F.greatest("overlap", F.lit(1))
    hint = lambda test, code: F.when(test, F.lit(code))
    hints = F.array_compact(F.array(F.when(share > 0.9, "systematic").otherwise("episodic"), hint(F.col("worst") > 0.5, "too_large"), hint((F.col("worst") > 0.001) & (F.col("worst") < 0.05), "small_print")))
    return report.select("pair_id", "overlap", "mismatches", F.when(F.col("mismatches") > 0, F.array_join(hints, ",")).otherwise("").alias("hints"))


def horizon_grid(most: int = 400) -> list[int]:
    """Every session to 20, every fifth to 100, every tenth to 400."""
    return [h for h in (*range(1, 21), *range(25, 101, 5), *range(110, 401, 10)) if h <= most]


def pooled_projection(panel: DataFrame, regime: Column, horizons: list[int], shrink: float = 1e-4, least: float = 5.0, rows_least: int = 20) -> DataFrame:
    """Slope of the gap h sessions on, its intercept and R squared, pooled over each regime's pairs after demeaning within the
    pair, and a pooled row (null regime); horizons under ``rows_least`` sessions are left out, and every regime's path ends at the
    first one with fewer than ``least`` sessions for each step ahead.  From 12 on a slope counts as identified."""
    every = Window.partitionBy("pair_id")
    rows = panel.withColumn("regime", regime).withColumn("x", F.col("pi") - F.avg("pi").over(every))
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), F.lead("x", h).over(by_pair()).alias("y")) for h in horizons))
    pairs = rows.withColumn("ahead", ahead).select("regime", "x", F.explode("ahead").alias("a")).select("regime", "x", "a.h", "a.y").where("y is not null")
    n = F.count("*")
    sums = pairs.groupingSets([["regime", "h"], ["h"]], "regime", "h").agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("x") * n).alias("sxx"), (F.var_pop("y") * n).alias("syy"), F.grouping("regime").alias("pooled")
    )
    path = Window.partitionBy("pooled", "regime").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    kept = sums.where(f"n >= {rows_least}").withColumn("room", F.min(F.col("n") / F.col("h")).over(path)).where(f"room >= {least}").withColumn("rho", F.expr(f"sxy / (sxx + {shrink})"))
    unexplained = F.expr("syy - 2 * rho * sxy + rho * rho * sxx")
    return kept.select("regime", "h", "n", "rho", F.expr("my - rho * mx").alias("alpha"), (1 - unexplained / F.nullif("syy", F.lit(0.0))).alias("r2"), F.expr("n / h >= 12").alias("identified"))
