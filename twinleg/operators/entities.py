"""Entity resolution: names that contain a needle, by a q-gram index instead of comparing all pairs, and what is resolved from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of pooled vehicles (fixed values), names kept for a needle, and letters of an index gram.
VEHICLES = ["FUND", "TRUST", "PORTFOLIO", "ETF", "INDEX", "SERIES"]
MOST, GRAM = 25, 3


def normal(name: Column) -> Column:
    """Upper case without points and commas."""
    return F.translate(F.upper(name), ".,", "")


def _grams(text: Column, q: Column | int) -> Column:
    """The different runs of ``q`` letters of ``text``."""
    q = F.lit(q) if isinstance(q, int) else q
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, q)))


def containing(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Rows (needle, normal_needle, *names, normal_name) of ``names`` (name, ...) whose normal form contains that of ``needles``
    (needle); empty and null ones match nothing.

    Names are posted under their runs of up to GRAM letters.  A needle asks the rarest of its own runs only, so a frequent run is
    read for the needles that hold nothing rarer; the names found are then tested.  Names and needles may hold nulls and repeats.
    """
    short = needles.select("needle", normal(F.col("needle")).alias("normal_needle")).where("length(normal_needle) > 0").distinct()
    asked = short.withColumn("gram", F.explode(_grams(F.col("normal_needle"), F.least(F.length("normal_needle"), F.lit(GRAM)))))
    held = names.select("name", normal(F.col("name")).alias("normal_name")).where("length(normal_name) > 0").distinct()
    every = F.flatten(F.array(*(_grams(F.col("normal_name"), q) for q in range(1, GRAM + 1))))
    posts = held.select("name", "normal_name", F.explode(every).alias("gram"))
    sizes = posts.groupBy("gram").agg(F.count("*").alias("names"))
    # a run that no name holds is the rarest of all: its needle finds nothing
    rarest = asked.join(sizes.hint("merge"), "gram", "left").groupBy("needle", "normal_needle").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
    found = rarest.hint("merge").join(posts, "gram").where(F.contains("normal_name", "normal_needle"))
    return found.select("needle", "normal_needle", "name", "normal_name").join(names.hint("merge"), "name")


def first_of(matches: DataFrame, order: list[Column], most: int, by: str = "needle") -> DataFrame:
    """The first ``most`` rows of each ``by`` under ``order``, numbered from 1 as ``rank``; cut before the shuffle too."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def candidates(names: DataFrame, needles: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` of ``names`` (id, name) containing each needle: those that begin with it first, then those without a
    vehicle's word, then the shortest, then by name and id."""
    vehicle = F.exists(F.array(*map(F.lit, VEHICLES)), lambda w: F.contains("name", w))
    prefix = F.startswith("normal_name", "normal_needle")
    found = containing(names, needles).select("needle", "id", "name", prefix.alias("prefix"), vehicle.alias("vehicle"))
    return first_of(found, [~F.col("prefix"), F.col("vehicle"), F.length("name"), F.col("name"), F.col("id")], most)


def by_capability(ranked: DataFrame, filings: DataFrame, cutoff: str, limit: int = 8) -> DataFrame:
    """Per needle its first candidate whose newest filing since ``cutoff`` holds anything: needle, id, name, rank, filings, newest.

    ``filings`` are (id, report_date, holdings); only an id's ``limit`` newest are looked at.  Needles without one don't appear:
    an empty book and an absent one are both no answer.
    """
    recent = first_of(filings.where("id is not null"), [F.col("report_date").desc()], limit, "id").where(F.col("report_date") >= F.lit(cutoff).cast("date"))
    able = recent.groupBy("id").agg(F.count("*").alias("filings"), F.max("report_date").alias("newest"), F.max_by("holdings", "report_date").alias("held")).where("held > 0")
    both = ranked.join(able.hint("merge"), "id")
    return both.groupBy("needle").agg(F.min_by(F.struct("id", "name", "rank", "filings", "newest"), "rank").alias("m")).select("needle", "m.*")


def registration(registry: DataFrame, needles: DataFrame) -> DataFrame:
    """Per needle the best of ``registry`` (id, name, status) holding its first word: active first, then names that begin with
    the needle, the shortest, by name and id.  ``refused`` tells a near-miss: the name doesn't begin with the needle's first two
    words; its id and name are then null, as another firm's number would be worse than none."""
    words = needles.select("needle", F.element_at(F.split(F.trim(normal(F.col("needle"))), " +"), 1).alias("word")).distinct()
    found = containing(registry, words.select(F.col("word").alias("needle")).distinct()).select(F.col("needle").alias("word"), "id", "name", "status", "normal_name")
    both = words.hint("merge").join(found, "word").withColumn("normal_needle", normal(F.col("needle")))
    order = [F.col("status") != "ACTIVE", ~F.startswith("normal_name", "normal_needle"), F.length("normal_name"), F.col("name"), F.col("id")]
    best = first_of(both, order, 1)
    lead = F.array_join(F.slice(F.split(F.trim("normal_needle"), " +"), 1, 2), " ")
    good = F.startswith("normal_name", lead)
    return best.select("needle", F.when(good, F.col("id")).alias("id"), F.when(good, F.col("name")).alias("name"), F.when(good, F.col("status")).alias("status"), (~good).alias("refused"))


def watched(holdings: DataFrame, watch: DataFrame) -> DataFrame:
    """``holdings`` (issuer, ...) whose issuer contains any of ``watch`` (needle), with the needles found, sorted."""
    hits = containing(holdings.select(F.col("issuer").alias("name")).distinct(), watch).groupBy(F.col("name").alias("issuer")).agg(F.array_sort(F.collect_set("needle")).alias("watched"))
    return holdings.join(hits.hint("merge"), "issuer")
