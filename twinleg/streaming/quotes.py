"""Intraday quotes as Structured Streaming: source, gate, bars, contemporaneous gap, gap runs and level changes.

All functions take a streaming or a batch DataFrame of quotes(captured_at, symbol, last, provider_ts, error), so a batch run
over the same rows is the reference for a stream's result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUOTE = "captured_at timestamp, symbol string, last double, provider_ts string, error string"


def quote_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only JSON lines; files are taken as they arrive."""
    return spark.readStream.schema(QUOTE).json(folder)


def quotes_only(records: DataFrame) -> DataFrame:
    """Records that carry a price; gap records have an error or none."""
    return records.where("error is null and last is not null")


def in_hours(quotes: DataFrame, hours: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Quotes inside their symbol's local market hours (zone, opening, close as HH:mm, both ends in), Monday to Friday.

    ``hours`` is a registry of a few symbols; symbols that it doesn't name are left out.
    """
    test = F.lit(False)
    for symbol, (zone, opening, close) in hours.items():
        local = F.from_utc_timestamp(F.to_utc_timestamp("captured_at", F.current_timezone()), zone)
        test = test | ((F.col("symbol") == symbol) & F.dayofweek(local).between(2, 6) & F.date_format(local, "HH:mm").between(opening, close))
    return quotes.where(test)


def once(quotes: DataFrame, late: str) -> DataFrame:
    """Each provider quote once: repeats within the watermark are dropped."""
    return quotes.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["symbol", "provider_ts"])


def bars(quotes: DataFrame, width: str = "1 minute", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and count of each symbol and window; ``slide`` makes the windows overlap."""
    w = F.window("captured_at", width, slide) if slide else F.window("captured_at", width)
    order = F.struct("captured_at", "last")
    out = quotes.withWatermark("captured_at", late).groupBy(w.alias("w"), "symbol")
    out = out.agg(F.min_by("last", order).alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", order).alias("close"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "symbol", "open", "high", "low", "close", "n")


def contemporaneous_gap(quotes: DataFrame, adr: str, local: str, fx: str, ratio: float, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The gap from the last quotes of all three legs in the same window; one aggregation instead of stream-stream joins.

    Windows without any leg give no row: silence is not a flat market.
    """
    leg = lambda s: F.max_by(F.when(F.col("symbol") == s, F.col("last")), F.when(F.col("symbol") == s, F.struct("captured_at", "last")))
    out = quotes.where(F.col("symbol").isin(adr, local, fx)).withWatermark("captured_at", late).groupBy(F.window("captured_at", width).alias("w"))
    out = out.agg(leg(adr).alias("adr"), leg(local).alias("local"), leg(fx).alias("fx")).where("adr is not null and local is not null and fx is not null")
    return out.select(F.col("w.start").alias("start"), "adr", "local", "fx", (F.try_divide(F.col("adr") * F.col("fx"), ratio * F.col("local")) - 1).alias("pi"))


def gap_runs(records: DataFrame, silence: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Runs of gap records of a symbol that are less than ``silence`` apart."""
    gaps = records.where("error is not null").withWatermark("captured_at", late)
    out = gaps.groupBy(F.session_window("captured_at", silence).alias("w"), "symbol").agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def level_changes(quotes: DataFrame, least: float) -> DataFrame:
    """(symbol, captured_at, previous, level, kind): changes of a symbol's level of at least ``least`` of the level before.

    The state of a symbol is its last level; rows of a micro-batch are taken in the order of their capture.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["captured_at", "last"])
        level = rows["last"].to_numpy()
        out = pd.DataFrame({"symbol": key[0], "captured_at": rows["captured_at"].to_numpy(), "previous": pd.Series([before, *level[:-1]], dtype="float64").to_numpy(), "level": level})
        state.update((float(level[-1]),))
        share = (out["level"] - out["previous"]).abs() / out["previous"].abs()
        out["kind"] = (out["level"] > out["previous"]).map({True: "creation", False: "consumption"})
        yield out[share >= least]

    rows = quotes.where("last is not null").select("symbol", "captured_at", "last")
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, captured_at timestamp, previous double, level double, kind string", "level double", "append", GroupStateTimeout.NoTimeout)
