"""What a short premium position costs to hold: rate legs, components, waterfalls, surfaces, thresholds, margin returns and fans.

Rates are in percent a year, carry in basis points a year; a positive carry is a cost.  Everything is by pair, so it grows with the
pairs, and grids are arrays of parameters exploded beside each pair's one row.  A pair without one of its rates has null sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_pair
from .trades import CONVERSION_BP, FLOOR

#: Borrow spreads by bracket and the two published parts of the house card, in basis points a year (fixed values).
BORROW_BP = {"low": 150.0, "mid": 400.0, "high": 900.0}
CARD_BP = {"financing spread": 50.0, "rebate haircut": 75.0}
#: Joint stress: how many times the card, and the quoted basis (fixed values).
STRESS = {"base": (1.0, 0.0), "squeeze": (1.5, -25.0), "crisis": (2.0, -50.0)}
LOCKED = "crisis, card locked"
EARNED, PAID, CARD, BASIS, FEE, SPECIAL = "rate earned", "funding paid", "house card", "currency basis", "conversion fee", "name special"
SUBTOTAL, ALL_IN, BREAKEVEN, HEADROOM = "non-borrow subtotal", "all-in", "breakeven", "headroom"
#: Margin used where no schedule is given, percent of notional (fixed value).
ILLUSTRATIVE_MARGIN = 20.0


def rate_legs(rates: DataFrame) -> DataFrame:
    """GRD-05: each pair's last rates of rates(pair_id, leg, date, rate), leg ``earned`` or ``paid``.

    Each leg is read at its own last date and at its own frequency: none is moved to the other's dates.  Null rates don't count.
    The differential is null where a leg is missing.
    """
    leg = lambda k: F.col("leg") == k
    parts = []
    for k in ("earned", "paid"):
        day = F.when(leg(k), F.col("date"))
        parts += [F.max_by(F.when(leg(k), F.col("rate")), day).alias(f"{k}_pct"), F.max(day).alias(f"{k}_as_of"), F.count(day).alias(f"{k}_n")]
    legs = rates.where("rate is not null and date is not null").groupBy("pair_id").agg(*parts)
    return legs.withColumn("differential_bp", (F.col("earned_pct") - F.col("paid_pct")) * 100)


def conversion(days: float) -> float:
    """The conversion fee spread over ``days`` sessions, a year."""
    return CONVERSION_BP * 252 / days


def _lines(legs: DataFrame, carried: list[str], lines: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row for each line (component, basis points, status), numbered from 1 in the given order."""
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("component"), bp.cast("double").alias("bp_year"), status.alias("status")) for i, (name, bp, status) in enumerate(lines, 1)))
    return legs.select("pair_id", *carried, F.explode(rows).alias("r")).select("pair_id", *carried, "r.*").withColumn("bp_month", F.col("bp_year") / 12)


def components(legs: DataFrame, days: float = 252.0, borrow: dict[str, float] | None = None) -> DataFrame:
    """GRD-06: (pair_id, bracket, place, component, bp_year, status, bp_month) for every bracket of the borrow spread.

    The status tells what is known: MEASURED, BRACKETED, DOCUMENTED, or NOT MEASURED (the basis, which counts as nought).
    """
    borrow = BORROW_BP if borrow is None else borrow
    brackets = F.array(*(F.struct(F.lit(k).alias("bracket"), F.lit(float(v)).alias("bp")) for k, v in borrow.items()))
    rows = legs.withColumn("b", F.explode(brackets)).withColumn("bracket", F.col("b.bracket"))
    s = F.lit
    return _lines(rows, ["bracket"], [(EARNED, -100 * F.col("earned_pct"), s("MEASURED")), (PAID, 100 * F.col("paid_pct"), s("MEASURED")), (SPECIAL, F.col("b.bp"), s("BRACKETED")), (BASIS, s(0.0), s("NOT MEASURED")), (FEE, s(conversion(days)), s("DOCUMENTED"))])


def _sum(value: Column) -> Column:
    """A sum that is null as soon as a part is."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def critical_bp(pi: Column, half_life: Column, days: float) -> Column:
    """The carry at which a gap of that half-life exactly pays over ``days`` sessions."""
    return (1e4 * (pi - FLOOR) * (1 - F.pow(F.lit(2.0), -days / half_life)) - CONVERSION_BP) * 252 / days


def summary(parts: DataFrame, levels: DataFrame, days: float = 252.0) -> DataFrame:
    """GRD-06: totals of ``components`` against the critical carry of levels(pair_id, pi, half_life), by pair and bracket: all that
    is measured nets to a tailwind or not, headroom, and whether the position pays.  Without a level the comparisons are null."""
    known = F.when(F.col("status") == "MEASURED", F.col("bp_year")).when(F.col("status") != "MEASURED", 0.0)
    totals = parts.groupBy("pair_id", "bracket").agg(_sum(F.col("bp_year")).alias("total_bp"), _sum(known).alias("funding_bp"), F.sort_array(F.collect_set(F.when(F.col("status") == "NOT MEASURED", F.col("component")))).alias("open"))
    both = totals.join(levels.select("pair_id", critical_bp(F.col("pi"), F.col("half_life"), days).alias("critical_bp")).hint("merge"), "pair_id", "left")
    return both.select("pair_id", "bracket", "total_bp", (F.col("total_bp") / 12).alias("month_bp"), "funding_bp", (F.col("funding_bp") < 0).alias("tailwind"), "critical_bp", (F.col("critical_bp") - F.col("total_bp")).alias("headroom_bp"), (F.col("total_bp") < F.col("critical_bp")).alias("pays"), F.concat_ws(", ", "open").alias("unmeasured"))


def rate_shift(totals: DataFrame, shift_bp: float = 25.0) -> DataFrame:
    """GRD-06: the carry after the earned rate moves by ``shift_bp``.  It is earned, so a rise makes holding cheaper."""
    return totals.select("pair_id", "bracket", "total_bp", (F.col("total_bp") - shift_bp).alias("after_rise_bp"), (F.col("total_bp") + shift_bp).alias("after_cut_bp"), F.lit(shift_bp / 12).alias("month_bp_a_shift"))


def card_bp(times: float = 1.0, locked: bool = False) -> float:
    """The house card under stress; term financing locks it, so that no stress moves it."""
    return sum(CARD_BP.values()) * (1.0 if locked else times)


def waterfall(legs: DataFrame, specials: list[float], basis_bp: float, times: float = 1.0, locked: bool = False, days: float = 252.0, live: bool = False) -> DataFrame:
    """GRD-07, WIN-22: the carry of each pair at each name special, line by line, with the running sum in basis points a month.

    The borrow is split: the card is published, the special is not, and they are stressed apart.  A quoted basis below nought is a
    cost.  ``live`` says that specials and basis are quotes; both must be given, as neither has a usual value.
    """
    quoted = F.lit("MEASURED" if live else "BRACKETED")
    rows = legs.withColumn("special_bp", F.explode(F.array(*(F.lit(float(x)) for x in specials))))
    lines = _lines(rows, ["special_bp"], [(EARNED, -100 * F.col("earned_pct"), F.lit("MEASURED")), (PAID, 100 * F.col("paid_pct"), F.lit("MEASURED")), (CARD, F.lit(card_bp(times, locked)), F.lit("DOCUMENTED")), (BASIS, F.lit(-basis_bp), quoted), (FEE, F.lit(conversion(days)), F.lit("DOCUMENTED")), (SPECIAL, F.col("special_bp"), quoted)])
    return lines.withColumn("running_month", F.sum("bp_month").over(Window.partitionBy("pair_id", "special_bp").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))


def waterfall_table(fall: DataFrame, levels: DataFrame, specials: list[float], days: float = 252.0) -> DataFrame:
    """GRD-07: (pair_id, place, line, bp150, ...) in basis points a month: the components, their subtotal without the special, the
    sum, the breakeven of levels(pair_id, pi, half_life), and the headroom below it.

    Every row is sent to the lines that it counts in, with its sign, so one grouping by pair gives components and totals alike.  A
    pair without a level has null breakeven and headroom.
    """
    to = lambda line, place, sign: F.struct(F.lit(line).alias("line"), F.lit(place).alias("place"), F.lit(sign).alias("sign"))
    own = F.struct(F.col("component").alias("line"), F.col("place"), F.lit(1.0).alias("sign"))
    totals = [to(ALL_IN, 8, 1.0), to(HEADROOM, 10, -1.0)]
    goes = F.when(F.col("component") == SPECIAL, F.array(own, *totals)).otherwise(F.array(own, to(SUBTOTAL, 7, 1.0), *totals))
    cost = fall.select("pair_id", "special_bp", "bp_month", F.explode(goes).alias("t"))
    pairs = fall.select("pair_id", "special_bp").distinct().join(levels.select("pair_id", "pi", "half_life").hint("merge"), "pair_id", "left")
    worth = pairs.select("pair_id", "special_bp", (critical_bp(F.col("pi"), F.col("half_life"), days) / 12).alias("bp_month"), F.explode(F.array(to(BREAKEVEN, 9, 1.0), to(HEADROOM, 10, 1.0))).alias("t"))
    rows = cost.unionByName(worth).select("pair_id", "t.place", "t.line", "special_bp", (F.col("bp_month") * F.col("t.sign")).alias("v"))
    named = {s: f"bp{s:g}" for s in specials}
    at = lambda s: F.col("special_bp") == float(s)
    cell = lambda s: F.when(F.count_if(at(s) & F.col("v").isNull()) == 0, F.sum(F.when(at(s), F.col("v"))))
    return rows.groupBy("pair_id", "place", "line").agg(*(cell(s).alias(n) for s, n in named.items()))


def non_borrow_bp(earned: Column, paid: Column, basis_bp: float, times: float = 1.0, locked: bool = False, days: float = 252.0) -> Column:
    """All of the waterfall but the name special, a year."""
    return 100 * (paid - earned) + card_bp(times, locked) - basis_bp + conversion(days)


def _levelled(legs: DataFrame, levels: DataFrame) -> DataFrame:
    return legs.join(levels.hint("merge"), "pair_id")


def surface(legs: DataFrame, levels: DataFrame, specials: list[float], basis_bp: float, live_bp: float | None = None, steps: int = 12, most: float = 400.0, days: float = 252.0, times: float = 1.0, locked: bool = False) -> DataFrame:
    """GRD-08: what the trade bears less what it costs, in basis points a month, over name specials and half-lives.

    levels(pair_id, pi, lower, point, upper) gives the bounds; each pair's half-lives run from its lower to its upper bound in
    ``steps`` equal parts, rounded to sessions, the same one once.  An open upper bound ends at ``most`` sessions, the longest
    horizon asked, or at the point beyond it; a lower one that isn't resolved starts at one.  ``marked`` is the cell next to
    (live_bp, point), ties by the smaller special, then half-life; without a live quote none is.  A pair without a point has no surface.
    """
    rows = _levelled(legs, levels).where("point is not null").withColumns({"lower": F.coalesce("lower", F.lit(1.0)), "upper": F.coalesce("upper", F.greatest(F.lit(most), "point"))})
    lives = F.expr(f"array_distinct(transform(sequence(0, {steps}), i -> greatest(round(lower + i * (upper - lower) / {steps}), 1.0D)))")
    grid = rows.withColumn("half_life", F.explode(lives)).withColumn("special_bp", F.explode(F.array(*(F.lit(float(x)) for x in specials))))
    cost = non_borrow_bp(F.col("earned_pct"), F.col("paid_pct"), basis_bp, times, locked, days) + F.col("special_bp")
    out = grid.withColumn("net_month", (critical_bp(F.col("pi"), F.col("half_life"), days) - cost) / 12)
    if live_bp is None:
        return out.select("pair_id", "special_bp", "half_life", "net_month", F.lit(False).alias("marked"))
    near = F.struct(F.abs(F.col("special_bp") - live_bp), "special_bp", F.abs(F.col("half_life") - F.col("point")), "half_life")
    marked = F.row_number().over(Window.partitionBy("pair_id").orderBy(near)) == 1
    return out.select("pair_id", "special_bp", "half_life", "net_month", marked.alias("marked"))


def threshold_special(legs: DataFrame, levels: DataFrame, days: float = 252.0) -> DataFrame:
    """GRD-09: the name special at which the trade exactly breaks even, by pair, half-life bound (lower, point, upper) and joint
    state of stress, and in a crisis with the card locked.

    It is solved, as the surface is linear in the special.  ``bought_bp`` is what locking the card buys: the same at every half-life.
    Bounds that are null are left out.
    """
    bounds = F.explode(F.array(*(F.struct(F.lit(b).alias("bound"), F.col(b).cast("double").alias("half_life")) for b in ("lower", "point", "upper"))))
    rows = _levelled(legs, levels).withColumn("h", bounds).withColumn("critical", critical_bp(F.col("pi"), F.col("h.half_life"), days)).where("h.half_life > 0")
    special = lambda times, basis, locked: F.col("critical") - non_borrow_bp(F.col("earned_pct"), F.col("paid_pct"), basis, times, locked, days)
    states = [F.struct(F.lit(k).alias("state"), special(t, b, False).alias("special_bp")) for k, (t, b) in STRESS.items()]
    times, basis = STRESS["crisis"]
    states.append(F.struct(F.lit(LOCKED).alias("state"), special(times, basis, True).alias("special_bp")))
    out = rows.withColumn("s", F.explode(F.array(*states)))
    bought = F.when(F.col("s.state") == LOCKED, card_bp(times) - card_bp(times, True)).otherwise(0.0)
    return out.select("pair_id", F.col("h.bound").alias("bound"), F.col("h.half_life").alias("half_life"), "s.state", "s.special_bp", bought.alias("bought_bp"))


def margin_returns(legs: DataFrame, moves_pp: list[float], specials: list[float], horizons: list[int], basis_bp: float, margin_pct: float | None = None, days: float = 252.0) -> DataFrame:
    """GRD-14: gain and return on initial margin at each last move of the premium, name special and horizon: the move and the carry
    only, no path.  Without a margin schedule the illustrative one divides, and every row says so."""
    grid = legs
    for name, values in (("move_pp", moves_pp), ("special_bp", specials), ("sessions", horizons)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    carry = non_borrow_bp(F.col("earned_pct"), F.col("paid_pct"), basis_bp, days=days) + F.col("special_bp")
    gain = -F.col("move_pp") - carry / 100 * F.col("sessions") / 252
    margin = ILLUSTRATIVE_MARGIN if margin_pct is None else margin_pct
    return grid.select("pair_id", "move_pp", "special_bp", "sessions", gain.alias("gain_pct"), (gain / margin).alias("on_margin"), F.lit("ILLUSTRATIVE" if margin_pct is None else "MEASURED").alias("status"))


def gain_fan(panel: DataFrame, sessions: int, annual_bp: dict[str, float]) -> DataFrame:
    """GRD-18: the certain financing of each bracket, in points, for t = 0 to ``sessions``, and around it the band of the gap's daily
    deviation times the root of t (no drift), whole and half.  A pair with fewer than two changes has a null band."""
    change = panel.select("pair_id", ((F.col("pi") - F.lag("pi").over(by_pair())) * 100).alias("d"))
    sd = change.groupBy("pair_id").agg(F.expr("try_divide(stddev_samp(d), 1)").alias("sd"))
    brackets = F.array(*(F.struct(F.lit(k).alias("bracket"), F.lit(float(v)).alias("bp")) for k, v in annual_bp.items()))
    rows = sd.withColumn("b", F.explode(brackets)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(sessions))))
    mid, band = 0 - F.col("b.bp") / 100 * F.col("t") / 252, F.col("sd") * F.sqrt("t")
    return rows.select("pair_id", "b.bracket", "t", mid.alias("financing_pp"), (mid - band).alias("low_pp"), (mid + band).alias("high_pp"), (mid - band / 2).alias("half_low_pp"), (mid + band / 2).alias("half_high_pp"))
