"""Which series a pair is measured from: providers, shared legs, sample limits, variants of the gap, coverage, instants and hedges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinleg.session import registry

from .premium import premium

#: Labels of a registered pair that takes no part in a class (fixed values).
FORWARD, EXCLUDED, WITHHELD, UNREACHABLE = "forward test (never fitted)", "excluded", "candidate: classification withheld", "unreachable: no data landed"


def first_provider(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """SRC-04: ``rows`` (series_id, provider, ...) of the first provider of chain(series_id, provider, place) that has any.

    One provider serves the whole series, never a mixture, and its name stays on every row.  Providers outside the chain don't
    serve; of a provider listed twice the first place counts.  A series that none serves has no rows; ``unserved`` names it.
    """
    order = chain.groupBy("series_id", "provider").agg(F.min("place").alias("place"))
    have = rows.select("series_id", "provider").distinct()
    serving = have.join(registry(order), ["series_id", "provider"]).groupBy("series_id").agg(F.min_by("provider", F.struct("place", "provider")).alias("provider"))
    return rows.join(registry(serving), ["series_id", "provider"])


def unserved(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """SRC-04: (series_id, tried) of every series whose chain has no rows at all, the providers in the chain's order."""
    dead = chain.join(first_provider(rows, chain).select("series_id").distinct().hint("merge"), "series_id", "left_anti")
    return dead.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "provider"))), lambda x: x["provider"]), " > ").alias("tried"))


def with_fallback(own: DataFrame, shared: DataFrame) -> DataFrame:
    """SRC-03: all of ``own`` (series_id, ...), and of ``shared`` the series that ``own`` lacks; ``source`` tells which."""
    lacking = shared.join(registry(own.select("series_id").distinct()), "series_id", "left_anti")
    return own.withColumn("source", F.lit("own")).unionByName(lacking.withColumn("source", F.lit("shared")))


def within_sample(date: Column, start: str | None = None) -> Column:
    """PRJ-02: whether a day is within sample_start and sample_end (both ends in, null is open); ``start`` may only narrow it."""
    lo = F.col("sample_start") if start is None else F.greatest(F.col("sample_start"), F.lit(start).cast("date"))
    return date.isNotNull() & F.coalesce(date >= lo, F.lit(True)) & F.coalesce(date <= F.col("sample_end"), F.lit(True))


def axes(pairs: DataFrame, fx_legs: dict[str, str]) -> DataFrame:
    """JOIN-02: (pair_id, fx_leg, fx_series): every one of ``fx_legs`` (name to series) for pairs with ``many_fx``, else ``native``."""
    legs = F.array(*(F.struct(F.lit(k).alias("fx_leg"), F.lit(v).alias("fx_series")) for k, v in fx_legs.items()))
    native = F.array(F.struct(F.lit("native").alias("fx_leg"), F.col("fx").alias("fx_series")))
    return pairs.select("*", F.explode(F.when(F.col("many_fx"), legs).otherwise(native)).alias("x")).select(*pairs.columns, "x.fx_leg", "x.fx_series")


def sides(bars: DataFrame, pairs: DataFrame, start: str | None = None) -> DataFrame:
    """(pair_id, close_def, date, adr, local) within each pair's sample, a side null where its series has no close that day.

    ``bars`` are (series_id, close_def, date, close), one row each; a series may serve several pairs.
    """
    roles = pairs.select("pair_id", "sample_start", "sample_end", F.expr("stack(2, 'adr', adr, 'local', local) AS (role, series_id)"))
    rows = bars.where("close is not null").join(registry(roles), "series_id").where(within_sample(F.col("date"), start))
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("close"))).alias(r)
    return rows.groupBy("pair_id", "close_def", "date").agg(side("adr"), side("local"))


def all_variants(bars: DataFrame, fx: DataFrame, pairs: DataFrame, fx_legs: dict[str, str], start: str | None = None) -> DataFrame:
    """JOIN-02: (pair_id, fx_leg, close_def, date, adr, local, fx, pi) of every FX leg and definition of the close whose inputs
    exist; a combination that lacks one has no rows.

    pairs(pair_id, adr, local, fx, ratio, many_fx, sample_start, sample_end) name series; fx(series_id, date, fx).  Both equity legs
    come from one grouping of the bars, keyed by pair, definition and day, so a large pair is spread by its days; FX meets them by
    series and day.  Rows without any of the three legs are left out: no price is carried forward.
    """
    both = sides(bars, pairs, start).dropna(subset=["adr", "local"])
    legs = _fx_rows(fx, pairs, fx_legs, start)
    return both.join(legs.hint("merge"), ["pair_id", "date"]).select("pair_id", "fx_leg", "close_def", "date", "adr", "local", "fx", premium(F.col("adr"), F.col("fx"), F.col("ratio"), F.col("local")).alias("pi"))


def _fx_rows(fx: DataFrame, pairs: DataFrame, fx_legs: dict[str, str], start: str | None) -> DataFrame:
    """(pair_id, ratio, fx_leg, fx_series, date, fx): each pair's FX legs within its sample."""
    use = axes(pairs.select("pair_id", "ratio", F.col("fx").alias("fx"), "many_fx", "sample_start", "sample_end"), fx_legs).drop("fx", "many_fx")
    rows = fx.where("fx is not null").withColumnRenamed("series_id", "fx_series").join(registry(use), "fx_series")
    return rows.where(within_sample(F.col("date"), start)).select("pair_id", "ratio", "fx_leg", "fx_series", "date", "fx")


def variant_table(bars: DataFrame, fx: DataFrame, pairs: DataFrame, fx_legs: dict[str, str], start: str | None = None) -> DataFrame:
    """JOIN-02: each variant's sessions, first and last day, what the join dropped of its longest leg, FX series and whether the
    ratio is confirmed."""
    found = all_variants(bars, fx, pairs, fx_legs, start).groupBy("pair_id", "fx_leg", "close_def").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    rows = sides(bars, pairs, start).groupBy("pair_id", "close_def").agg(F.greatest(F.count("adr"), F.count("local")).alias("side_rows"))
    fx_rows = _fx_rows(fx, pairs, fx_legs, start).groupBy("pair_id", "fx_leg", "fx_series").agg(F.count("*").alias("fx_rows"))
    out = found.join(rows.hint("merge"), ["pair_id", "close_def"]).join(fx_rows.hint("merge"), ["pair_id", "fx_leg"]).join(pairs.select("pair_id", "confirmed").hint("merge"), "pair_id")
    return out.select("pair_id", "fx_leg", "close_def", "n", "first_date", "last_date", (F.greatest("side_rows", "fx_rows") - F.col("n")).alias("dropped"), "fx_series", "confirmed")


def panel_coverage(pairs: DataFrame, table: DataFrame, leads: list[str]) -> DataFrame:
    """AGG-09, PRJ-10: a row for every registered pair, also those excluded or without data, with its label, span and why its sample
    is limited (the first sentence).

    The span is that of the pair's first variant: FX legs in the order of ``leads``, others after, then the close whose name is
    greater, as ``primary`` comes before ``consolidated``.  Class null means withheld where there are data, else unreachable.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, leads)), F.col("fx_leg")), F.lit(0)), F.lit(len(leads) + 1))
    first = table.withColumn("k", F.row_number().over(Window.partitionBy("pair_id").orderBy(place, "fx_leg", F.col("close_def").desc()))).where("k = 1").select("pair_id", "n", "first_date", "last_date")
    rows = pairs.join(first.hint("merge"), "pair_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    label = F.when(F.col("forward_test"), FORWARD).when(F.col("excluded"), EXCLUDED).otherwise(F.coalesce("class", F.when(F.col("n") > 0, WITHHELD).otherwise(UNREACHABLE)))
    why = F.nullif(F.substring_index("sample_reason", ".", 1), F.lit(""))
    return rows.select("pair_id", label.alias("label"), "n", "first_date", "last_date", "ratio", "confirmed", "sample_start", "sample_end", why.alias("restriction"))


def instants(bars: DataFrame, series: DataFrame) -> DataFrame:
    """PRJ-04: ``bars`` (series_id, date, ...) with the instants, in UTC, that the close refers to and that it was known.

    series(series_id, timezone, close_local 'HH:mm', lag_min).  The zone's own rule decides, so summer time moves the instant, not
    the local hour.  A series without an entry has null instants, and so has one without a zone or an hour.
    """
    at = F.expr("make_timestamp(year(date), month(date), day(date), int(split(close_local, ':')[0]), int(split(close_local, ':')[1]), 0, timezone)")
    rows = bars.join(registry(series.select("series_id", "timezone", "close_local", "lag_min")), "series_id", "left").withColumn("observed_at", at)
    return rows.withColumn("known_at", F.expr("observed_at + make_dt_interval(0, 0, lag_min)")).drop("timezone", "close_local", "lag_min")


def last_legs(panel: DataFrame) -> DataFrame:
    """(pair_id, date, adr, local, fx, pi): each pair's last session that has all legs."""
    return panel.groupBy("pair_id").agg(F.max_by(F.struct("date", "adr", "local", "fx", "pi"), "date").alias("l")).select("pair_id", "l.*")


def fx_hedge(legs: DataFrame, ratio: float, receipts: float = 1.0) -> DataFrame:
    """PRJ-06: what to sell forward to cover the local leg of ``receipts`` short receipts, and the rest that it leaves open.

    The rest is the premium as money: its share of the receipts' worth is pi / (1 + pi), which ``identity_error`` checks.
    """
    rows = legs.withColumn("local_notional", receipts * ratio * F.col("local")).withColumn("local_usd", F.col("local_notional") / F.col("fx")).withColumn("adr_usd", receipts * F.col("adr"))
    rows = rows.withColumn("residual_usd", F.col("adr_usd") - F.col("local_usd")).withColumn("residual_share", F.try_divide("residual_usd", "adr_usd"))
    return rows.select("pair_id", "date", "local_notional", "local_usd", "adr_usd", "residual_usd", "residual_share", (F.col("residual_share") - F.try_divide(F.col("pi"), 1 + F.col("pi"))).alias("identity_error"))


def fx_sensitivity(legs: DataFrame, coefficients: DataFrame, moves: list[float]) -> DataFrame:
    """PRJ-07: the premium's move in points for each proportional ``moves`` of FX: by the identity, (1 + pi) times the move, and by
    coefficients(pair_id, coef, low, high), which hold what both equity legs take back; both are given, none replaces the other."""
    rows = legs.join(coefficients.hint("merge"), "pair_id", "left").withColumn("move", F.explode(F.array(*map(F.lit, moves))))
    analytic = 100 * (1 + F.col("pi")) * F.col("move")
    band = lambda c: F.col(c) * analytic
    return rows.select("pair_id", "date", "pi", "move", analytic.alias("analytic_pp"), band("coef").alias("central_pp"), F.least(band("low"), band("high")).alias("low_pp"), F.greatest(band("low"), band("high")).alias("high_pp"))
