"""Shares on loan and programme headroom: the current state, what it is worth, readiness, ledgers, publication and flow episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import trailing_rank

#: Rows that folds need, sessions of the rank's window, and the least share of the level that is an episode (fixed values).
FOLD_ROWS, RANK_WINDOW, RANK_LEAST, EPISODE = 60, 1250, 60, 0.0025
SILENT, PUBLISHING, ALIGNED = "indeterminate", "publishing", "aligned"


def lending_now(lending: DataFrame, window: int = RANK_WINDOW, least: int = RANK_LEAST, tail: int = 5) -> DataFrame:
    """AGG-41, TOP-03: each pair's last ranked row of lending(pair_id, date, balance, net): balance, rank in its own trailing history,
    state, net lending of the last ``tail`` ranked sessions, and the number of ranked ones.

    It is a relative state, no utilisation: what could be lent isn't public.  Rows before the rank's least history don't count; a
    pair that has none isn't in the result.  A null net counts as nought.
    """
    rows = trailing_rank(lending, window, least, "balance").where("rank is not null")
    recent = rows.withColumn("back", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.col("date").desc())))
    last = lambda c: F.max_by(c, "date").alias(c)
    return recent.groupBy("pair_id").agg(F.max("date").alias("as_of"), last("balance"), last("rank"), last("state"), F.coalesce(F.sum(F.when(F.col("back") <= tail, F.col("net"))), F.lit(0)).alias("net_recent"), F.count("*").alias("n"))


def borrow_ceiling(now: DataFrame, legs: DataFrame) -> DataFrame:
    """AGG-39: what is on loan in dollars, at the local price and FX of each pair's last session with all legs(pair_id, local, fx).

    A balance on loan is no depth: it is a lower bound of what can be found.  ``available`` is false without common legs.
    """
    rows = now.join(legs.select("pair_id", F.col("date").alias("priced_on"), "local", "fx").hint("merge"), "pair_id", "left")
    return rows.select("pair_id", "as_of", "priced_on", F.col("balance").alias("on_loan_shares"), F.try_divide(F.col("balance") * F.col("local"), F.col("fx")).alias("on_loan_usd"), "rank", "state", F.col("priced_on").isNotNull().alias("available"))


def readiness(captures: DataFrame, pairs: DataFrame, least: int = FOLD_ROWS) -> DataFrame:
    """AGG-42: for every one of pairs(pair_id, fitted) the different days of captures(pair_id, day), whether they are enough for
    folds, and whether the pair is usable, ready and fitted.  A day captured twice counts once; a pair without any has nought."""
    days = captures.where("day is not null").groupBy("pair_id").agg(F.count_distinct("day").alias("days"))
    rows = pairs.join(days.hint("merge"), "pair_id", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return rows.select("pair_id", "days", (F.col("days") >= least).alias("ready"), (F.coalesce("fitted", F.lit(False)) & (F.col("days") >= least)).alias("usable"))


def ablation(ready: DataFrame) -> DataFrame:
    """AGG-42: counts of pairs, ready and usable ones, and whether an ablation is possible, which takes a usable pair."""
    return ready.agg(F.count("*").alias("pairs"), F.count_if("ready").alias("ready"), F.count_if("usable").alias("usable")).withColumn("ablatable", F.col("usable") > 0)


def _moves(headroom: DataFrame) -> DataFrame:
    """headroom(programme, date, headroom) with the change from the row before; of equal dates the greater level is the later."""
    w = Window.partitionBy("programme").orderBy("date", "headroom")
    return headroom.where("headroom is not null and date is not null").select("programme", "date", "headroom", (F.col("headroom") - F.lag("headroom").over(w)).alias("delta"))


def ledger_state(headroom: DataFrame, programmes: DataFrame) -> DataFrame:
    """AGG-44: for every one of programmes(programme, ...) the observations, first and last day, level, creations and consumptions, the
    latest move, and a note: sealed at nought, a single observation (publishing on change only would look alike), or not landed."""
    at = F.struct("date", "headroom")
    found = _moves(headroom).groupBy("programme").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("headroom", at).alias("level"), F.count_if(F.col("delta") > 0).alias("creations"), F.count_if(F.col("delta") < 0).alias("consumptions"), F.max_by("delta", at).alias("latest_move"))
    rows = programmes.join(found.hint("merge"), "programme", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "creations", "consumptions")})
    notes = F.array_compact(F.array(F.when(F.col("n") == 0, "not landed"), F.when(F.col("level") == 0, "sealed"), F.when(F.col("n") == 1, "single observation")))
    return rows.withColumn("note", F.array_join(notes, ", "))


def publication(states: DataFrame, group: str) -> DataFrame:
    """AGG-45: tells no movement from no publication, by ``group``: states of ``ledger_state`` with a ``role``, capped or control.

    Without a control that landed it is indeterminate; a control that printed after the capped programme shows that the feed lives,
    so the capped one has not moved; else both are aligned, also where the capped one never printed.
    """
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("last_date")))
    rows = states.groupBy(group).agg(last("capped").alias("capped_last"), last("control").alias("control_last"))
    return rows.withColumn("verdict", F.when(F.col("control_last").isNull(), SILENT).when(F.col("capped_last") < F.col("control_last"), PUBLISHING).otherwise(ALIGNED))


def flow_episodes(headroom: DataFrame, least: float = EPISODE) -> DataFrame:
    """WIN-19: changes of at least ``least`` of the programme's last level, with their share of it and direction.  A programme whose
    last level is nought has no scale and no episodes."""
    whole = Window.partitionBy("programme").orderBy("date", "headroom").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _moves(headroom).withColumn("share", F.try_divide(F.abs("delta"), F.abs(F.last("headroom").over(whole))))
    return rows.where((F.col("share") >= least) & (F.col("delta") != 0)).select("programme", "date", "delta", "share", F.when(F.col("delta") > 0, "creation").otherwise("consumption").alias("direction"))
