"""Rule guards: every broken rule is a row of violations(rule, key, detail), and a gate raises on the blocking ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import effective

#: Columns of an event that may not be null.
REQUIRED = ["id", "date", "known_from", "market", "category", "title", "detail", "source"]
#: Two statistics closer than this, relatively, count as the same.
CLOSE = 1e-9


def _violation(rule: str, key: Column | str, detail: Column | str) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("(none)")).cast("string").alias("key"), (F.col(detail) if isinstance(detail, str) else detail).cast("string").alias("detail")]


def event_violations(events: DataFrame, markets: list[str]) -> DataFrame:
    """Broken rules of events(id, date, known_from, market, category, title, detail, source: text; confounded_with: array; supersedes).

    missing: required columns that are null, by name.  date: not a calendar day written yyyy-MM-dd.  market: outside ``markets``.
    duplicate: an id of several rows, once, with their number.  reference: a confounded id that no event has, once for each
    event row and reference.  unresolved: events that nothing supersedes whose known_from still starts with TODO.  An event can
    break several rules; an empty calendar breaks none.
    """
    day = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    absent = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in REQUIRED))), ",")
    each = F.array_compact(F.array(
        F.when(absent != "", F.struct(F.lit("missing").alias("rule"), absent.alias("detail"))),
        F.when(F.col("date").isNotNull() & ~day, F.struct(F.lit("date").alias("rule"), F.col("date").alias("detail"))),
        F.when(~F.col("market").isin(markets), F.struct(F.lit("market").alias("rule"), F.col("market").alias("detail")))))
    rows = events.select("id", F.explode(each).alias("x")).select("x.rule", F.coalesce("id", F.lit("(none)")).alias("key"), "x.detail")
    twice = events.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(*_violation("duplicate", "id", "n"))
    refs = events.select("id", F.explode("confounded_with").alias("ref")).where("ref is not null")
    ids = events.where("id is not null").select(F.col("id").alias("ref")).distinct()
    lost = refs.join(ids.hint("merge"), "ref", "left_anti").select(*_violation("reference", "id", "ref"))
    still = effective(events).where("known_from like 'TODO%'").select(*_violation("unresolved", "id", "known_from"))
    return rows.unionByName(twice).unionByName(lost).unionByName(still)


def identity_violations(returned: DataFrame, registry: DataFrame) -> DataFrame:
    """identity: codes of ``registry``(code, name) for which ``returned``(code, name) holds another name, one row for each
    such name with the name asked for; a null name is another one.  Codes outside the registry were not asked for."""
    names = returned.groupBy("code", "name").agg(F.count("*").alias("rows"))
    both = names.join(registry.select("code", F.col("name").alias("asked")).hint("merge"), "code").where("not name <=> asked")
    text = lambda c: F.coalesce(c, F.lit("(none)"))
    return both.select(*_violation("identity", F.col("code").cast("string"), F.concat(text("asked"), F.lit(" / "), text("name"), F.lit(" x "), F.col("rows"))))


def forward_test_violations(fitted: DataFrame, held_back: list[str]) -> DataFrame:
    """forward_test: instruments of ``held_back``, in either case, that stand among the rows a model is fitted on."""
    low = F.lower("pair_id")
    found = fitted.where(low.isin([h.lower() for h in held_back])).groupBy(low.alias("pair_id")).agg(F.count("*").alias("n"))
    return found.select(*_violation("forward_test", "pair_id", "n"))


def availability_violations(features: DataFrame) -> DataFrame:
    """availability: rows of features(pair_id, decision_ts, avail_ts) that were public only at the decision or later, by pair and
    decision, with the first offender's time.  A feature without a time can't be shown to be late and passes."""
    late = features.where("avail_ts >= decision_ts").groupBy("pair_id", "decision_ts").agg(F.min("avail_ts").alias("first"), F.count("*").alias("n"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return late.select(*_violation("availability", F.concat("pair_id", F.lit("@"), stamp("decision_ts")), F.concat(stamp("first"), F.lit(" x "), F.col("n"))))


def scaler_violations(fits: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """scaler: folds of ``fits``(keys, fold, mean, std) whose mean or deviation is that of the whole sample in ``full``(keys, mean, std)."""
    both = fits.join(full.select(*keys, F.col("mean").alias("mean_all"), F.col("std").alias("std_all")).hint("merge"), keys)
    same = lambda c: F.abs(F.col(c) - F.col(f"{c}_all")) <= 1e-8 + CLOSE * F.abs(f"{c}_all")
    which = F.array_join(F.array_compact(F.array(F.when(same("mean"), "mean"), F.when(same("std"), "std"))), ",")
    return both.withColumn("which", which).where("which <> ''").select(*_violation("scaler", F.concat_ws("/", *keys, "fold"), "which"))


def smoothed_violations(probabilities: DataFrame) -> DataFrame:
    """smoothed: series(name, smoothed, p) marked as smoothed, which see the whole sample; empty: series whose p is null throughout."""
    by = probabilities.groupBy("name").agg(F.bool_or("smoothed").alias("smoothed"), F.count("p").alias("n"))
    seen = by.where("smoothed").select(*_violation("smoothed", "name", F.lit("descriptive only")))
    return seen.unionByName(by.where("n = 0").select(*_violation("empty", "name", F.lit("no probabilities"))))


def require_none(violations: DataFrame, blocking: list[str]) -> DataFrame:
    """``violations`` of the rules that don't block; raises ValueError with the counts by rule where one of ``blocking`` is broken."""
    counts = violations.where(F.col("rule").isin(blocking)).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("key")).orderBy("rule").collect()  # a row for each rule
    if counts:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} violations, first {r['key']}" for r in counts))
    return violations.where(~F.col("rule").isin(blocking))
