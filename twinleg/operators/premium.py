"""The premium panel: leg joins, the gap, its summaries and decompositions.  Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_pair():
    return Window.partitionBy("pair_id").orderBy("date")


def join_legs(bars: DataFrame, fx: DataFrame, adr: str = "A", local: str = "N") -> DataFrame:
    """Inner join of the three legs on pair and date: pair_id, date, adr, local, fx, volume, high, low.

    Both equity legs come from one scan of the bars by a conditional aggregation, so there is no self-join.  Prices are never
    carried forward: a session without any leg is dropped.
    """
    leg = lambda flag, c: F.max(F.when(F.col("leg") == flag, F.col(c)))
    sides = bars.where(F.col("leg").isin(adr, local)).groupBy("pair_id", "date").agg(leg(adr, "close").alias("adr"), leg(local, "close").alias("local"), leg(adr, "volume").alias("volume"), leg(adr, "high").alias("high"), leg(adr, "low").alias("low"))
    return sides.dropna(subset=["adr", "local"]).join(fx, "date").dropna(subset=["fx"])


def premium(adr: Column, fx: Column, ratio: Column, local: Column) -> Column:
    """The receipt's price over its local shares' price, less one."""
    return adr * fx / (ratio * local) - 1


def with_premium(legs: DataFrame, ratio: float) -> DataFrame:
    return legs.withColumn("pi", premium(F.col("adr"), F.col("fx"), F.lit(ratio), F.col("local")))


def summary(panel: DataFrame, key: str = "pair_id") -> DataFrame:
    """Sessions, first and last day, mean, least, largest and last premium of each pair."""
    return panel.groupBy(key).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("pi").alias("mean_pi"), F.min("pi").alias("min_pi"), F.max("pi").alias("max_pi"), F.max_by("pi", "date").alias("last_pi"))


def join_loss(bars: DataFrame, panel: DataFrame, adr: str = "A", local: str = "N") -> DataFrame:
    """Rows of both equity legs, joined sessions, and what the join dropped of the longer leg."""
    rows = bars.groupBy("pair_id").agg(F.count_if(F.col("leg") == adr).alias("adr_rows"), F.count_if(F.col("leg") == local).alias("local_rows"))
    out = rows.join(panel.groupBy("pair_id").agg(F.count("*").alias("joined")), "pair_id", "left").withColumn("joined", F.coalesce("joined", F.lit(0)))
    return out.withColumn("dropped", F.greatest("adr_rows", "local_rows") - F.col("joined"))


def latest_common(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """The last session that has all legs, its premium, and how many days each equity leg is fresher."""
    last = panel.groupBy("pair_id").agg(F.max("date").alias("last_date"), F.max_by("pi", "date").alias("last_pi"))
    ends = bars.groupBy("pair_id").agg(F.max(F.when(F.col("leg") == "A", F.col("date"))).alias("a"), F.max(F.when(F.col("leg") == "N", F.col("date"))).alias("b"))
    return last.join(ends, "pair_id").select("pair_id", "last_date", "last_pi", F.date_diff("a", "last_date").alias("adr_fresher"), F.date_diff("b", "last_date").alias("local_fresher"))


def scheduled_ratio(panel: DataFrame, schedule: DataFrame, gaps: DataFrame) -> DataFrame:
    """Interval join: the ratio in force (half-open segments of the schedule), gap windows (both ends) taken out.

    schedule(from_date, ratio) and gaps(lo, hi) are registries of a few rows; sessions before the first segment are dropped.
    """
    segments = schedule.withColumn("to_date", F.lead("from_date").over(Window.orderBy("from_date")))
    inside = (F.col("date") >= F.col("from_date")) & (F.col("to_date").isNull() | (F.col("date") < F.col("to_date")))
    return panel.join(F.broadcast(segments), inside).join(F.broadcast(gaps), F.col("date").between(F.col("lo"), F.col("hi")), "left_anti").drop("from_date", "to_date")


def as_of(facts: DataFrame, slow: DataFrame, key: str, value: str) -> DataFrame:
    """Carry the last known ``value`` of ``slow``(key, date, value) onto the rows of ``facts`` by a union and one window."""
    both = facts.withColumn("__fact", F.lit(True)).unionByName(slow.withColumn("__fact", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__fact").drop("__fact")


def reconcile(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Two providers' closes per pair: overlap, days only in one, mismatches beyond ``tolerance``, worst relative difference."""
    both = a.select("pair_id", "date", F.col("close").alias("x")).join(b.select("pair_id", "date", F.col("close").alias("y")), ["pair_id", "date"], "full_outer")
    gap = F.abs(F.col("x") - F.col("y")) / F.when(F.abs("y") > 0, F.abs("y")).otherwise(F.lit(1.0))
    out = both.withColumn("gap", gap).groupBy("pair_id").agg(F.count("gap").alias("overlap"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.col("gap") > tolerance).alias("mismatches"), F.max("gap").alias("worst"))
    return out.withColumn("agrees", (F.col("overlap") > 0) & (F.col("mismatches") == 0))


def variant_spread(panel: DataFrame) -> DataFrame:
    """Pairwise spread in basis points of the variants of a pair: panel(pair_id, variant, date, pi)."""
    a, b = panel.select("pair_id", "date", F.col("variant").alias("a"), F.col("pi").alias("x")), panel.select("pair_id", "date", F.col("variant").alias("b"), F.col("pi").alias("y"))
    gap = F.abs(F.col("x") - F.col("y")) * 10000
    both = a.join(b, ["pair_id", "date"]).where("a < b").withColumn("gap", gap)
    return both.groupBy("pair_id", "a", "b").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_bp"), F.expr("percentile(gap, 0.5)").alias("median_bp"), F.expr("percentile(gap, 0.95)").alias("p95_bp"), F.max("gap").alias("max_bp"))


def decomposition(panel: DataFrame) -> DataFrame:
    """Per session: change of ln(1 + pi) and its parts from the receipt, FX and local share."""
    d = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by_pair())
    out = panel.withColumn("gap", F.col("pi") + 1).select("pair_id", "date", d("gap").alias("dgap"), d("adr").alias("dadr"), d("fx").alias("dfx"), d("local").alias("dlocal"))
    return out.dropna(subset=["dgap"])


def attribution(parts: DataFrame) -> DataFrame:
    """Identity error, mean absolute parts in basis points, and the parts' shares (they need not sum to one)."""
    mean = lambda c: F.avg(F.abs(c))
    return parts.groupBy("pair_id").agg(F.max(F.abs(F.expr("dadr + dfx - dlocal - dgap"))).alias("identity_error"), *((mean(f"d{c}") * 10000).alias(f"{c}_bp") for c in ("adr", "fx", "local")), *((mean(f"d{c}") / mean("dgap")).alias(f"{c}_share") for c in ("adr", "fx", "local")))


def variance_parts(parts: DataFrame) -> DataFrame:
    """Variance of the gap's change as variances and covariances of the parts; the residual is zero up to rounding."""
    out = parts.groupBy("pair_id").agg(F.var_samp("dgap").alias("var_gap"), F.var_samp("dadr").alias("var_adr"), F.var_samp("dfx").alias("var_fx"), F.var_samp("dlocal").alias("var_local"), F.covar_samp("dadr", "dfx").alias("cov_adr_fx"), F.covar_samp("dadr", "dlocal").alias("cov_adr_local"), F.covar_samp("dfx", "dlocal").alias("cov_fx_local"))
    return out.withColumn("residual", F.expr("var_gap - (var_adr + var_fx + var_local + 2 * cov_adr_fx - 2 * cov_adr_local - 2 * cov_fx_local)"))


def coverage(bars: DataFrame) -> DataFrame:
    """Rows, first, last and widest gap in days of every series."""
    w = Window.partitionBy("pair_id", "leg").orderBy("date")
    gaps = bars.withColumn("gap", F.date_diff("date", F.lag("date").over(w)))
    return gaps.groupBy("pair_id", "leg").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("gap").alias("max_gap"), F.count_if(F.col("close").isNull()).alias("null_closes"))


def calendar_cost(bars: DataFrame) -> DataFrame:
    """Within the span that both equity legs share: sessions of both, of only one, by pair."""
    flags = bars.where("leg in ('A', 'N')").groupBy("pair_id", "date").agg(F.bool_or(F.col("leg") == "A").alias("a"), F.bool_or(F.col("leg") == "N").alias("n"))
    w = Window.partitionBy("pair_id")
    edge = lambda f, side: f(F.when(F.col(side), F.col("date"))).over(w)
    spans = flags.select("*", F.greatest(edge(F.min, "a"), edge(F.min, "n")).alias("lo"), F.least(edge(F.max, "a"), edge(F.max, "n")).alias("hi")).where("date between lo and hi")
    return spans.groupBy("pair_id").agg(F.count_if(F.expr("a and n")).alias("both"), F.count_if(F.expr("a and not n")).alias("adr_only"), F.count_if(F.expr("n and not a")).alias("local_only"))


def event_window(panel: DataFrame, day: str, before: int, after: int) -> DataFrame:
    """Sessions around each pair's first session at or after ``day``, numbered from it."""
    numbered = panel.withColumn("rn", F.row_number().over(by_pair())).withColumn("anchor", F.min(F.when(F.col("date") >= F.lit(day).cast("date"), F.col("rn"))).over(Window.partitionBy("pair_id")))
    return numbered.withColumn("offset", F.col("rn") - F.col("anchor")).where(f"offset between -{before} and {after}").select("pair_id", "date", "offset", "pi")
