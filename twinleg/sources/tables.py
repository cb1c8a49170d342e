"""Tables of the premium analytics, derived from the given star schema: bars, FX, legs and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local shares per receipt used for the derived pairs (scales the FX column to about one).
RATIO = 150000.0
#: Suppliers are broadcast up to this size, at 64 bytes a row.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's region as pair_id.

    The suppliers' regions are broadcast while, counted, they take at most BROADCAST_BYTES; beyond that they are joined by sorting.
    """
    # nation and region have a fixed number of rows
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = suppliers.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("pair_id"))
    fits = suppliers.limit(BROADCAST_BYTES // 64 + 1).count() <= BROADCAST_BYTES // 64
    return read(spark, sf_dir, "lineitem").join(F.broadcast(pairs) if fits else pairs.hint("merge"), F.col("l_suppkey") == F.col("s_suppkey"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(pair_id, leg, date, close, high, low, volume): one row per region, return flag and ship date.

    Line items take their region first and are summed before the one shuffle, to a row for each region, flag and day.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    items = market_items(spark, sf_dir).groupBy("pair_id", F.col("l_returnflag").alias("leg"), F.col("l_shipdate").cast("date").alias("date"))
    return items.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").cast("long").alias("volume"))


def daily_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx(date, fx): local units per dollar, one row a day."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("fx"))
