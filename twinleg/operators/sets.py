"""Set operations on calendars and ledgers, and the monthly join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_sets(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Every session of either leg once, marked both, first (only ``a``) or second (only ``b``).

    Union, intersection and differences of two calendars come from one aggregation instead of three set operations.
    """
    days = bars.where(F.col("leg").isin(a, b)).groupBy("pair_id", "date").agg(F.bool_or(F.col("leg") == a).alias("a"), F.bool_or(F.col("leg") == b).alias("b"))
    return days.select("pair_id", "date", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``, whose columns must settle ties.  An aggregation, so that copies are combined
    before the shuffle and a hot key is no single sort."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in others))


def effective(events: DataFrame, key: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """Events that no other event supersedes; a reference to an unknown event drops nothing."""
    gone = events.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key))
    return events.join(gone.hint("merge"), key, "left_anti")


def month_gap(daily: DataFrame, monthly: DataFrame, column: str = "pi") -> DataFrame:
    """Monthly means of ``daily`` beside ``monthly``(pair_id, month, value), months of both only, and their difference."""
    means = daily.groupBy("pair_id", F.trunc("date", "month").alias("month")).agg(F.avg(column).alias("mean"), F.count(column).alias("days"))
    return means.join(monthly, ["pair_id", "month"]).withColumn("difference", F.col("mean") - F.col("value"))


def quintile_changes(panel: DataFrame, column: str = "pi") -> DataFrame:
    """Mean change to the next session by quintile of the starting level; edges are exact quantiles of the pair."""
    step = F.lead(column).over(Window.partitionBy("pair_id").orderBy("date")) - F.col(column)
    rows = panel.withColumn("step", step).where("step is not null")
    edges = rows.groupBy("pair_id").agg(F.expr(f"percentile({column}, array(0.2, 0.4, 0.6, 0.8))").alias("edges"))
    out = rows.join(edges, "pair_id").withColumn("quintile", F.expr(f"1 + size(filter(edges, e -> e < {column}))"))
    return out.groupBy("pair_id", "quintile").agg(F.count("*").alias("n"), F.avg("step").alias("mean_step"))
