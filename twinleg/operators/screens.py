"""Screens of managers from public filings: families held at once, watched books, manifests, brokers, best fits, and all beside each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinleg.session import cut_lineage, registry

from .entities import containing, first_of

#: What a manager's filed traits fit, decided before any ordering (fixed names).
FULL, BORROW, LOCAL, PASS = "full package", "borrow + financing", "long-local financing", "pass"
NO_FILING, NO_OWNER, NO_ADVISER, NO_BROKER = "no filing found", "not in the ownership screen", "no adviser registration found", "none named"


def _named(holdings: DataFrame, issuers: DataFrame | None) -> DataFrame:
    if issuers is None:
        issuers = holdings.select("issuer", F.col("issuer").alias("name"))
    return issuers.select("issuer", "name").where("issuer is not null and name is not null").distinct()


def _quarters(holdings: DataFrame, issuers: DataFrame | None, watch: DataFrame | None = None, legs: DataFrame | None = None) -> DataFrame:
    """By manager and quarter, from one pass over ``holdings``: positions, book, and with ``watch`` the watched worth and ``needles``,
    with ``legs`` the ``pairs`` (family, leg) found.  The issuers found are computed once and counted, so holdings are read once more
    for them only where ``issuers`` isn't given."""
    names, rows, value = _named(holdings, issuers), holdings, F.coalesce("value", F.lit(0.0))
    sums = [F.count("*").alias("positions"), F.sum(value).alias("book")]
    if watch is not None:
        hits = containing(names, watch).groupBy("name").agg(F.collect_set("needle").alias("needles"))
        rows = rows.join(registry(cut_lineage(names.join(hits.hint("merge"), "name").select("issuer", "needles"))), "issuer", "left")
        sums += [F.sum(F.when(F.col("needles").isNotNull(), value)).alias("watched"), F.array_distinct(F.flatten(F.collect_set("needles"))).alias("needles")]
    if legs is not None:
        hits = containing(names, legs.select(F.col("leg").alias("needle"))).select("name", F.col("needle").alias("leg")).distinct()
        pairs = hits.join(registry(legs), "leg").groupBy("name").agg(F.collect_set(F.struct("family", "leg")).alias("pairs"))
        rows = rows.join(registry(cut_lineage(names.join(pairs.hint("merge"), "name").select("issuer", "pairs"))), "issuer", "left")
        sums += [F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")]
    return rows.groupBy("manager", "quarter").agg(*sums)


def _legs_of(family: Column) -> Column:
    return F.array_sort(F.transform(F.filter("pairs", lambda p: p["family"].eqNullSafe(family)), lambda p: p["leg"]))


def families(holdings: DataFrame, legs: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """AGG-47: (manager, quarter, family, legs, breadth) where one filing holds two or more different legs of legs(family, leg).

    holdings(manager, quarter, issuer, value); an issuer holds a leg if its name contains it.  ``issuers`` (issuer, name) gives the
    names; without it an issuer is its own name.  ``breadth``, the filing's positions, must be read beside it: a wide book holds two
    legs of almost any family.  Issuers are asked by an index of their different names.
    """
    quarters = _quarters(holdings, issuers, legs=legs).where("size(pairs) >= 2")
    held = quarters.withColumn("family", F.explode(F.array_distinct(F.transform("pairs", lambda p: p["family"])))).withColumn("legs", _legs_of(F.col("family"))).where("size(legs) >= 2")
    return held.select("manager", "quarter", "family", F.array_join("legs", ", ").alias("legs"), F.col("positions").alias("breadth"))


def _books(quarters: DataFrame, *more: Column) -> DataFrame:
    out = quarters.groupBy("manager").agg(
        F.max("quarter").alias("newest"), F.count("*").alias("quarters"), F.count("watched").alias("watched_quarters"),
        F.coalesce(F.max_by("watched", F.when(F.col("watched").isNotNull(), F.col("quarter"))), F.lit(0.0)).alias("watched_value"),
        F.flatten(F.collect_set("needles")).alias("names"), F.max("positions").alias("breadth"), F.max("book").alias("book"), *more)
    return out.withColumn("names", F.array_join(F.array_sort(F.array_distinct(F.transform("names", F.initcap))), ", "))


def watched_books(holdings: DataFrame, watch: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """AGG-48: by manager the newest quarter, quarters, those with any of ``watch`` (needle), the watched worth of the newest of these
    (nought if none), watched names, most positions and largest book of any quarter.  A null value counts as nought.  ``issuers``
    as in ``families``."""
    return _books(_quarters(holdings, issuers, watch))


def books_with_families(holdings: DataFrame, watch: DataFrame, legs: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """``watched_books``, and as ``families`` those held in any quarter (null if none), all from one pass over ``holdings``."""
    held = F.filter(F.array_distinct(F.transform("pairs", lambda p: p["family"])), lambda f: F.size(_legs_of(f)) >= 2)
    quarters = _quarters(holdings, issuers, watch, legs).withColumn("families", F.when(F.size("pairs") >= 2, held))
    books = _books(quarters, F.array_distinct(F.flatten(F.collect_set("families"))).alias("families"))
    return books.withColumn("families", F.when(F.size("families") > 0, F.array_join(F.array_sort("families"), ", ")))


def pull_manifest(filings: DataFrame, asked: DataFrame) -> DataFrame:
    """AGG-49: rows, first and last day of filings(issuer, filed_on) for every issuer of ``asked``; nought and nulls where none came."""
    found = filings.groupBy("issuer").agg(F.count("*").alias("rows"), F.min("filed_on").alias("first_date"), F.max("filed_on").alias("last_date"))
    return asked.select("issuer").distinct().join(found.hint("merge"), "issuer", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def common_brokers(mentions: DataFrame, noise: str, most: int = 3) -> DataFrame:
    """TOP-02: each manager's most named brokers of mentions(manager, name): rank, name, times, and how many different ones there are.

    Names are trimmed and in upper case; those of up to two letters or that ``noise`` matches at the start don't count.  Of equal
    counts the lesser name comes first.
    """
    name = F.upper(F.trim("name"))
    rows = mentions.select("manager", name.alias("name")).where((F.length("name") > 2) & ~F.rlike("name", F.lit(f"^(?:{noise})")))
    counts = rows.groupBy("manager", "name").agg(F.count("*").alias("times")).withColumn("brokers", F.count("*").over(Window.partitionBy("manager")))
    return first_of(counts, [F.col("times").desc(), F.col("name")], most, "manager")


def best_fits(managers: DataFrame, most: int = 12) -> DataFrame:
    """TOP-01: the first ``most`` of managers(manager, may_short, has_local, score, capacity) by score, with their product and place in it.

    The product follows from mandate and local leg alone; score and capacity only order, so no book is large enough to change it.
    Ties go to the larger capacity, then the lesser name; null scores come last.
    """
    short, local = F.coalesce("may_short", F.lit(False)), F.coalesce("has_local", F.lit(False))
    product = F.when(short & local, FULL).when(short, BORROW).when(local, LOCAL).otherwise(PASS)
    order = [F.col("score").desc_nulls_last(), F.col("capacity").desc_nulls_last(), F.col("manager")]
    top = managers.withColumn("product", product).orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.partitionBy("product").orderBy(*order))).select("manager", "product", "place", "score", "capacity")


def manager_screen(managers: DataFrame, books: DataFrame, held: DataFrame | None, owners: DataFrame, advisers: DataFrame, brokers: DataFrame) -> DataFrame:
    """JOIN-19: a row for every one of ``managers`` (manager) with each source's answer, and where a source has none, its stated absence.

    ``books`` are of ``watched_books``, ``held`` of ``families`` (or None, and ``books`` of ``books_with_families``), owners(manager,
    filed_on), advisers(manager, firm), ``brokers`` of ``common_brokers``.  Several filings of an owner count once, by the newest; of several firms the lesser name stands.
    """
    kinds = [] if held is None else [held.groupBy("manager").agg(F.array_join(F.array_sort(F.collect_set("family")), ", ").alias("families"))]
    filed = owners.groupBy("manager").agg(F.max("filed_on").cast("string").alias("owner"))
    firms = advisers.groupBy("manager").agg(F.min("firm").alias("adviser"))
    named = brokers.groupBy("manager").agg(F.concat(F.max("brokers").cast("string"), F.lit(" named: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ")).alias("brokers"))
    rows = managers.select("manager").distinct()
    for source in (books, *kinds, filed, firms, named):
        rows = rows.join(source.hint("merge"), "manager", "left")
    stated = lambda c, text: F.coalesce(c, F.lit(text)).alias(c)
    book = F.when(F.col("quarters").isNull(), NO_FILING).when(F.col("watched_quarters") == 0, "none").otherwise(F.concat("names", F.lit(": "), F.col("watched_quarters").cast("string"), F.lit("/"), F.col("quarters").cast("string"), F.lit(" quarters")))
    return rows.select("manager", book.alias("watched"), "watched_value", "breadth", "book", F.when(F.col("quarters").isNull(), NO_FILING).otherwise(F.coalesce("families", F.lit("none"))).alias("families"), stated("owner", NO_OWNER), stated("adviser", NO_ADVISER), stated("brokers", NO_BROKER))
