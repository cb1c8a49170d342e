"""Swings of the gap, what closed them, and what entries would have earned under carry and stops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import by_pair, expanding_percentile

# Annual carry by bracket and the round trip's conversion fee, in basis points, and the lower barrier of the gap.
CARRY_BP = {"low": 250.0, "mid": 600.0, "high": 1200.0}
CONVERSION_BP, FLOOR = 7.0, 0.0007


def turning_points(x: np.ndarray, threshold: float) -> list[int]:
    """Places of confirmed extremes, a peak first.  The walk opens with the first drop of ``threshold`` in one session."""
    drops = np.flatnonzero(x[:-1] - x[1:] >= threshold)
    if not len(drops):
        return []
    opening, side, best = int(drops[0]), -1, int(drops[0]) + 1
    while opening and x[opening - 1] == x[opening]:
        opening -= 1
    found = [opening]
    for i in range(best + 1, len(x)):
        further = side * (x[i] - x[best])
        if further > 0:
            best = i
        elif -further >= threshold:
            found.append(best)
            side, best = -side, i
    return found


def swings(panel: DataFrame, threshold: float, least_days: int) -> DataFrame:
    """(pair_id, start_date, end_date, direction, move, days) of swings of at least ``threshold`` and ``least_days`` sessions.

    The walk carries state from session to session, so each pair is one group; it holds one row for each day of the calendar.
    Rows without a gap are left out.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x, at = rows["pi"].to_numpy(), np.array(turning_points(rows["pi"].to_numpy(), threshold), int)
        a, b = at[:-1], at[1:]
        out = pd.DataFrame({"pair_id": rows["pair_id"].iloc[0], "start_date": rows["date"].to_numpy()[a], "end_date": rows["date"].to_numpy()[b], "direction": np.where(x[b] < x[a], "compression", "widening"), "move": np.abs(x[b] - x[a]), "days": b - a})
        return out[out["days"] >= least_days]

    return panel.where("pi is not null").select("pair_id", "date", "pi").groupBy("pair_id").applyInPandas(walk, "pair_id string, start_date date, end_date date, direction string, move double, days long")


def channels(found: DataFrame, panel: DataFrame) -> DataFrame:
    """The leg that closed each swing: the largest log contribution in the direction of the move, and its share of it."""
    ends = [panel.select("pair_id", F.col("date").alias(f"{e}_date"), *(F.ln(c).alias(f"{c}_{e}") for c in ("adr", "fx", "local")), F.log1p("pi").alias(f"gap_{e}")) for e in ("start", "end")]
    rows = found.hint("merge").join(ends[0], ["pair_id", "start_date"]).hint("merge").join(ends[1], ["pair_id", "end_date"])
    total = F.col("gap_end") - F.col("gap_start")
    part = {"adr_leg": F.expr("adr_end - adr_start"), "fx_leg": F.expr("fx_end - fx_start"), "local_leg": F.expr("local_start - local_end")}
    rows = rows.select(*found.columns, total.alias("total"), *(c.alias(k) for k, c in part.items()))
    led = {k: F.when(F.signum(k) == F.signum("total"), F.abs(k)) for k in part}
    most = F.greatest(*led.values())
    channel = F.lit("offsetting")
    for k in reversed(part):
        channel = F.when(led[k] == most, k).otherwise(channel)
    return rows.select("*", channel.alias("channel"), F.try_divide(most, F.abs("total")).alias("channel_share"))


def entries(panel: DataFrame, percentile: float, h: int, warm_up: int = 504) -> DataFrame:
    """Short-premium entries at or above the expanding percentile: gross gain over ``h`` sessions and the worst rise on the way."""
    rows = expanding_percentile(panel, warm_up).withColumn("ahead", F.lead("pi", h).over(by_pair())).withColumn("worst", F.max("pi").over(by_pair().rowsBetween(0, h)) - F.col("pi"))
    return rows.where(f"percentile >= {percentile} and ahead is not null").select("pair_id", "date", (F.col("pi") - F.col("ahead")).alias("gain"), "worst")


def carry_bp(annual: Column, days: Column) -> Column:
    """Annual carry and the conversion fee spread over the days held, in basis points a year."""
    return annual + CONVERSION_BP * 252 / days


def brackets() -> Column:
    """One struct(bracket, annual) for each carry bracket, for explode."""
    return F.array(*(F.struct(F.lit(k).alias("bracket"), F.lit(v).alias("annual")) for k, v in CARRY_BP.items()))


def entry_outcomes(made: DataFrame, h: int) -> DataFrame:
    """Net gain in points by pair and bracket: quartiles, share that beats the carry, and the worst rises."""
    cost = carry_bp(F.col("c.annual"), F.lit(float(h))) / 1e4 * h / 252
    rows = made.withColumn("c", F.explode(brackets())).select("pair_id", "c.bracket", ((F.col("gain") - cost) * 100).alias("net"), (F.col("worst") * 100).alias("worst"))
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    return rows.groupBy("pair_id", "bracket").agg(F.count("*").alias("n"), q("net", 0.25).alias("q25_net"), q("net", 0.5).alias("median_net"), q("net", 0.75).alias("q75_net"), F.avg((F.col("net") > 0).cast("double")).alias("beats_carry"), q("worst", 0.5).alias("median_worst"), q("worst", 0.95).alias("p95_worst"))


def stop_survival(made: DataFrame, stops: list[float]) -> DataFrame:
    """By stop distance in points: share of entries stopped, and of entries stopped though they would have won."""
    rows = made.withColumn("stop", F.explode(F.array(*map(F.lit, stops)))).withColumn("hit", F.col("worst") * 100 >= F.col("stop"))
    return rows.groupBy("pair_id", "stop").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("stopped"), F.avg((F.col("hit") & (F.col("gain") > 0)).cast("double")).alias("stopped_but_won"))


def breakeven(levels: DataFrame, horizons: list[int]) -> DataFrame:
    """Half-life at which the gain from ``pi`` pays the carry, for every row of ``levels``, horizon and bracket.

    Null where the carry exceeds the whole way to the floor.
    """
    rows = levels.withColumn("days", F.explode(F.array(*map(F.lit, horizons)))).withColumn("c", F.explode(brackets()))
    carry = carry_bp(F.col("c.annual"), F.col("days"))
    need, room = carry / 1e4 * F.col("days") / 252, F.col("pi") - FLOOR
    return rows.select(*levels.columns, "days", "c.bracket", carry.alias("carry_bp"), F.when((room > 0) & (need < room), -F.col("days") / F.log2(1 - need / room)).alias("half_life"))


def critical_carry(levels: DataFrame, half_life: float, days: int) -> DataFrame:
    """The annual carry in basis points at which a gap of that half-life exactly pays."""
    return levels.withColumn("critical_bp", (1e4 * (F.col("pi") - FLOOR) * (1 - F.pow(F.lit(2.0), F.lit(-days / half_life))) - CONVERSION_BP) * 252 / days)


def netting(panel: DataFrame, ratio: float) -> DataFrame:
    """Annualised deviations of both legs and of the hedged pair, and how much of the legs' sum the pair keeps."""
    d = lambda c: F.ln(c) - F.lag(F.ln(c)).over(by_pair())
    rows = panel.withColumn("usd", ratio * F.col("local") / F.col("fx")).withColumn("gap", 1 + F.col("pi")).select("pair_id", d("adr").alias("a"), d("usd").alias("l"), d("gap").alias("g"))
    vol = lambda c: F.stddev_samp(c) * F.sqrt(F.lit(252.0))
    out = rows.groupBy("pair_id").agg(F.count("*").alias("n"), vol("a").alias("vol_adr"), vol("l").alias("vol_local"), vol("g").alias("vol_pair"))
    return out.withColumn("ratio", F.expr("vol_pair / nullif(vol_adr + vol_local, 0)"))


def stress_session(panel: DataFrame) -> DataFrame:
    """The session of the widest range of each pair, as a multiple of the median range, and its volume against the mean."""
    rows = panel.withColumn("span", (F.col("high") - F.col("low")) / F.col("adr"))
    return rows.groupBy("pair_id").agg(F.max_by("date", F.struct("span", "date")).alias("date"), F.max("span").alias("widest"), F.try_divide(F.max("span"), F.expr("percentile(span, 0.5)")).alias("multiple"), F.try_divide(F.max_by("volume", F.struct("span", "date")), F.avg("volume")).alias("volume_multiple"))


def margin_stress(panel: DataFrame) -> DataFrame:
    """Entry at the first session against the peak: the rise and the sessions to it."""
    rows = panel.withColumn("rn", F.row_number().over(by_pair()))
    return rows.groupBy("pair_id").agg(F.min_by("pi", "date").alias("entry"), F.max("pi").alias("peak"), F.max_by("date", F.struct(F.col("pi"), -F.col("rn"))).alias("peak_date"), (F.max_by("rn", F.struct(F.col("pi"), -F.col("rn"))) - 1).alias("sessions")).withColumn("rise", F.col("peak") - F.col("entry"))


def fx_states(panel: DataFrame, k: int) -> DataFrame:
    """Terciles of the FX trend over ``k`` sessions, cut on the pair's whole sample: strength, neutral or weakness."""
    rows = panel.withColumn("move", -(F.col("fx") / F.lag("fx", k).over(by_pair()) - 1)).where("move is not null")
    cuts = rows.groupBy("pair_id").agg(F.expr("percentile(move, array(1/3D, 2/3D))").alias("cuts"))
    state = F.when(F.col("move") <= F.col("cuts")[0], "weakness").when(F.col("move") <= F.col("cuts")[1], "neutral").otherwise("strength")
    return rows.join(cuts.hint("merge"), "pair_id").withColumn("state", state).drop("cuts")
