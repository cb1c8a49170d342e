"""Conditional tables: what closed the swings in each state at their start, and which pairs such a test may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import mantel_haenszel

#: States in the order of the report, and the two whose swings form a pair's table.
STATES = ("strength", "neutral", "weakness")
FIRST, SECOND = "strength", "weakness"
CELLS = {"a": (FIRST, "local_leg"), "b": (FIRST, "adr_leg"), "c": (SECOND, "local_leg"), "d": (SECOND, "adr_leg")}
#: Least compressions of a testable state, sessions of a pair, and usable episodes of a pair.
LEAST_STATE, LEAST_SESSIONS, LEAST_EPISODES = 10, 1000, 5


def state_at_start(found: DataFrame, states: DataFrame) -> DataFrame:
    """Swings with the state of the very session they start on, so nothing later is seen; swings without a state drop."""
    return found.hint("merge").join(states.where("state is not null").select("pair_id", F.col("date").alias("start_date"), "state"), ["pair_id", "start_date"])


def conditional_channels(started: DataFrame, pairs: DataFrame, least: int = LEAST_STATE) -> DataFrame:
    """By pair and state: swings, compressions and their share, and the shares of compressions that each leg closed.

    Every pair of ``pairs`` has a row for each state, empty ones too: the states come from one aggregation's columns, not from a
    join.  Shares of nothing are null.
    """
    is_, falls = (lambda s: F.col("state") == s), F.col("direction") == "compression"
    counts = [c.alias(f"{k}_{i}") for i, s in enumerate(STATES) for k, c in {
        "n": F.count_if(is_(s)), "k": F.count_if(is_(s) & falls), "l": F.count_if(is_(s) & falls & (F.col("channel") == "local_leg")), "r": F.count_if(is_(s) & falls & (F.col("channel") == "adr_leg"))}.items()]
    wide = pairs.select("pair_id").join(started.groupBy("pair_id").agg(*counts).hint("merge"), "pair_id", "left").na.fill(0)
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), *(F.col(f"{k}_{i}").alias(k) for k in "nklr")) for i, s in enumerate(STATES))))
    rows = wide.select("pair_id", cells.alias("x")).select("pair_id", "x.*")
    share = lambda a, b: F.try_divide(a, b)
    return rows.select("pair_id", "state", F.col("n").alias("n_episodes"), F.col("k").alias("n_compression"), share("k", "n").alias("compression_share"), share("l", "k").alias("local_leg_share"), share("r", "k").alias("adr_leg_share"), (F.col("k") >= least).alias("testable"))


def require_members(registry: DataFrame, required: list[str]) -> None:
    """Raise ValueError where the registry lacks one of ``required``, a stated list."""
    held = {r["pair_id"] for r in registry.where(F.col("pair_id").isin(required)).select("pair_id").distinct().collect()}
    missing = sorted(set(required) - held)
    if missing:
        raise ValueError(f"the registry lacks {', '.join(missing)}")


def pair_tables(panel: DataFrame, found: DataFrame, started: DataFrame, registry: DataFrame, least_sessions: int = LEAST_SESSIONS, least_episodes: int = LEAST_EPISODES) -> DataFrame:
    """(pair_id, regime, n_sessions, n_compressions, a, b, c, d, shares, included, why) of each pair of ``registry`` that isn't a forward test.

    a and b count compressions begun in strength and closed by the local leg or the receipt, c and d those begun in weakness.
    An excluded pair stays, with what was counted and the first reason that applies: no legs, few sessions, no swings, few usable
    swings; cells that were not asked for are null.
    """
    sessions = panel.groupBy("pair_id").agg(F.count("*").alias("n_sessions"))
    swings = found.groupBy("pair_id").agg(F.count("*").alias("swings"))
    cell = lambda s, k: F.count_if((F.col("state") == s) & (F.col("channel") == k))
    counted = started.where("direction = 'compression'").groupBy("pair_id").agg(F.count("*").alias("n_compressions"), *(cell(*v).alias(k) for k, v in CELLS.items()))
    rows = registry.where("not forward_test").select("pair_id", "regime")
    for part in (sessions, swings, counted):
        rows = rows.join(part.hint("merge"), "pair_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sessions", "swings", "n_compressions", *CELLS)})
    why = (F.when(F.col("n_sessions") == 0, "legs unavailable").when(F.col("n_sessions") < least_sessions, f"under {least_sessions} sessions")
           .when(F.col("swings") == 0, "no episodes at the base rule").when(F.expr("a + b + c + d") < least_episodes, f"under {least_episodes} usable episodes").otherwise(""))
    asked = (F.col("n_sessions") >= least_sessions) & (F.col("swings") > 0)
    rows = rows.withColumn("why", why).withColumns({c: F.when(asked, F.col(c)) for c in ("n_compressions", *CELLS)})
    share = lambda x, y: F.expr(f"try_divide({x}, {x} + {y})")
    return rows.select("pair_id", "regime", "n_sessions", "n_compressions", *CELLS, share("a", "b").alias("strength_local_share"), share("c", "d").alias("weakness_local_share"), (F.col("why") == "").alias("included"), "why")


def scope_verdicts(tables: DataFrame, primary: str, alpha: float) -> DataFrame:
    """Pooled test of the included pairs by scope: the ``primary`` regime, and all; excluded pairs are counted.

    HELD where the pooled odds ratio exceeds one at ``alpha``.  A scope without usable pairs still has its row.
    """
    rows = tables.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("regime") == primary, "primary")))))
    counts = rows.groupBy("scope").agg(F.count_if("included").alias("n_pairs"), F.count_if(~F.col("included")).alias("n_excluded"), F.coalesce(F.sum(F.when(F.col("included"), F.expr("a + b + c + d"))), F.lit(0)).alias("n_episodes"))
    pooled = mantel_haenszel(rows.where("included").select("scope", *CELLS), ["scope"])
    out = counts.join(pooled.hint("merge"), "scope", "left")
    up = F.coalesce(F.col("odds_ratio") > 1, F.lit(False))
    return out.select(*counts.columns, "odds_ratio", "chi2", "p", up.alias("as_registered"), F.when(up & F.coalesce(F.col("p") < alpha, F.lit(False)), "HELD").otherwise("NULL").alias("verdict"))
