"""Decision tables as rules, and scenario paths with their gains, for positions of any number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .risk import margin_calls
from .series import by_pair

#: The states of a position, in order (fixed values), and the thresholds between them: percentage points of premium, basis points
#: of borrow a year, percent of collateral that is free.
STATES = {"premium_band": ["at/below anchor", "mid", "above entry"], "borrow_state": ["stable", "tightening", "recalled"], "margin_headroom": ["comfortable", "watch", "critical"]}
ANCHOR, ENTRY, STABLE, COMFORTABLE, CRITICAL = 15.0, 40.0, 400.0, 50.0, 10.0
#: The four actions, and the rules by priority: what a state must be, and what is then done; the first that fits decides.
HOLD, REDUCE, CONVERT, UNWIND = "hold", "reduce to D4 size", "convert to long-local TRS only", "unwind at ADV band"
RULES = [
    ({"margin_headroom": "critical"}, UNWIND),
    ({"borrow_state": "recalled"}, CONVERT),
    ({"margin_headroom": "watch"}, REDUCE),
    ({"premium_band": "at/below anchor"}, UNWIND),
    ({"borrow_state": "tightening"}, REDUCE),
    ({}, HOLD),
]
#: Borrow tiers by state of lending (fixed names).
TIERS = {"low": "linear pair", "normal": "standby", "tight": "long-local via TRS"}
Margin = Callable[[DataFrame], DataFrame]


def decision_table(spark: SparkSession, rules: list | None = None, states: dict[str, list[str]] | None = None) -> DataFrame:
    """GRD-15: one row for each combination of states, with the action and the number of the first rule that fits it.

    A rule that names no value of a state fits them all.  Raises where a rule names an unknown state or value, and, when read, where
    no rule fits a combination.
    """
    rules, states = RULES if rules is None else rules, STATES if states is None else states
    for when, _ in rules:
        for k, v in when.items():
            if v not in states.get(k, ()):
                raise ValueError(f"a rule asks for {k} = {v}, which is no state")
    table = spark.range(1).select(*(F.array(*map(F.lit, vs)).alias(k) for k, vs in states.items()))
    for k in states:
        table = table.withColumn(k, F.explode(k))
    fits = lambda when: [F.col(k) == v for k, v in when.items()]
    first = F.coalesce(*(F.when(_all(fits(when)), F.lit(i)) for i, (when, _) in enumerate(rules, 1)), F.raise_error(F.concat_ws(", ", F.lit("no rule for"), *states)).cast("int"))
    table = table.withColumn("rule", first)
    return table.withColumn("action", F.element_at(F.array(*(F.lit(a) for _, a in rules)), F.col("rule")))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def banded(positions: DataFrame) -> DataFrame:
    """``positions`` (premium_pp, borrow_bp, recalled, headroom_pct, ...) with their three states; a null input has a null state.

    A premium up to ANCHOR is at or below the anchor, one beyond ENTRY above entry.  A notice of recall decides at any rate, else a
    borrow up to STABLE is stable.  Headroom from COMFORTABLE on is comfortable, up to CRITICAL critical.
    """
    premium = F.when(F.col("premium_pp") <= ANCHOR, "at/below anchor").when(F.col("premium_pp") <= ENTRY, "mid").when(F.col("premium_pp") > ENTRY, "above entry")
    borrow = F.when(F.col("recalled"), "recalled").when(F.col("borrow_bp") <= STABLE, "stable").when(F.col("borrow_bp") > STABLE, "tightening")
    headroom = F.when(F.col("headroom_pct") <= CRITICAL, "critical").when(F.col("headroom_pct") < COMFORTABLE, "watch").when(F.col("headroom_pct") >= COMFORTABLE, "comfortable")
    return positions.withColumns({"premium_band": premium, "borrow_state": borrow, "margin_headroom": headroom})


def decided(positions: DataFrame, table: DataFrame) -> DataFrame:
    """Every position with its states, rule and action, by equality with the decision table (27 rows, broadcast); a position with
    a null state has no action."""
    return banded(positions).join(F.broadcast(table), list(STATES), "left")


def indicated_tier(states: DataFrame) -> DataFrame:
    """GRD-16: the tier that the last lending state of each pair (pair_id, date, state, rank) points at; an unknown state stands by.

    It is an indication, not a quote: shares on loan aren't the price of the next one.
    """
    last = states.where("state is not null").groupBy("pair_id").agg(F.max("date").alias("as_of"), F.max_by(F.struct("state", "rank"), "date").alias("m"))
    tiers = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    return last.select("pair_id", "as_of", "m.state", "m.rank", F.coalesce(F.try_element_at(tiers, "m.state"), F.lit(TIERS["normal"])).alias("tier"), F.lit(False).alias("is_a_quote"))


def scenario_paths(panel: DataFrame, days: int, half_life: float, floor: float) -> DataFrame:
    """GRD-10: (pair_id, t, path, level, start) for t = 0 to ``days`` from each pair's last gap: ``compression`` halves the distance
    to ``floor`` every ``half_life`` sessions, ``static`` stays, ``widening`` adds the moves that the pair made from its first session
    on and holds the last of them."""
    last = panel.groupBy("pair_id").agg(F.max_by("pi", "date").alias("start"), F.min_by("pi", "date").alias("first"))
    axis = last.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(days))))
    real = panel.select("pair_id", (F.row_number().over(by_pair()) - 1).alias("t"), "pi").where(F.col("t") <= days)
    whole = axis.join(real.hint("merge"), ["pair_id", "t"], "left")
    held = F.last("pi", ignorenulls=True).over(Window.partitionBy("pair_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    levels = whole.select("pair_id", "t", "start", (F.lit(floor) + (F.col("start") - floor) * F.pow(F.lit(2.0), -F.col("t") / half_life)).alias("compression"), F.col("start").alias("static"), (F.col("start") + held - F.col("first")).alias("widening"))
    return levels.select("pair_id", "t", "start", F.expr("stack(3, 'compression', compression, 'static', static, 'widening', widening) AS (path, level)"))


def path_gains(paths: DataFrame, carry_bp: dict[str, float]) -> DataFrame:
    """GRD-11: gain of a short premium position per unit of notional, for each path and bracket of yearly carry in basis points."""
    brackets = F.explode(F.array(*(F.struct(F.lit(b).alias("bracket"), F.lit(float(c)).alias("bp")) for b, c in carry_bp.items())))
    rows = paths.withColumn("b", brackets)
    return rows.select("pair_id", "t", "path", F.col("b.bracket").alias("bracket"), (F.col("start") - F.col("level") - F.col("b.bp") / 1e4 * F.col("t") / 252).alias("pnl"))


def netted_margin(panel: DataFrame) -> DataFrame:
    """UDF-02, the usual margin function: (pair_id, initial, peak) of the netted pair per unit of notional."""
    calls = margin_calls(panel)
    return calls.groupBy("pair_id").agg(F.min_by("total_pair", "date").alias("initial"), F.max("total_pair").alias("peak"))


def path_ends(gains: DataFrame, panel: DataFrame, margin: Margin = netted_margin) -> DataFrame:
    """GRD-11: the last gain of each path and bracket, per notional and in units of the initial margin that ``margin`` gives for
    ``panel`` (a function of DataFrame to DataFrame with pair_id, initial, peak); null without a margin."""
    ends = gains.groupBy("pair_id", "path", "bracket").agg(F.max_by("pnl", "t").alias("pnl"))
    both = ends.join(margin(panel).select("pair_id", "initial").hint("merge"), "pair_id", "left")
    return both.withColumn("margins", F.col("pnl") / F.nullif("initial", F.lit(0.0)))


def margin_sizing(panel: DataFrame, notionals: list[float], margin: Margin = netted_margin) -> DataFrame:
    """GRD-12: initial and peak margin in dollars at each notional, and how many times the peak is the initial one."""
    rows = margin(panel).withColumn("notional", F.explode(F.array(*map(F.lit, notionals))))
    return rows.select("pair_id", "notional", (F.col("initial") * F.col("notional")).alias("initial_usd"), (F.col("peak") * F.col("notional")).alias("peak_usd"), F.try_divide("peak", "initial").alias("multiple"))
