"""Provenance of landed tables: newest pulls, clean numbers, manifests, revisions; and scores over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the grammar of a partition's name, a day and an optional number.
PARTITION = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[.]([0-9]+))?$"


def newest_pull(files: DataFrame, keys: list[str], name: str = "partition") -> DataFrame:
    """The newest partition of every key: by day, then by number, which is compared as a number.

    Names outside the grammar don't count; a key without any valid name gives no row.
    """
    rows = files.where(F.col(name).rlike(PARTITION)).select(*keys, name, F.to_date(F.regexp_extract(name, PARTITION, 1)).alias("day"), F.coalesce(F.nullif(F.regexp_extract(name, PARTITION, 2), F.lit("")).try_cast("int"), F.lit(0)).alias("seq"))
    return rows.groupBy(*keys).agg(F.max(F.struct("day", "seq", name)).alias("top")).select(*keys, F.col(f"top.{name}").alias(name), "top.day", "top.seq")


def clean_number(c: str | Column) -> Column:
    """A number from text with currency, grouping or percent signs; dashes and N/A are null."""
    return F.nullif(F.regexp_replace(c, r"[$,%\s]", ""), F.lit("")).try_cast("double")


def merge_manifest(old: DataFrame, new: DataFrame, allow_update: bool = False) -> DataFrame:
    """(path, sha256, status, superseded): new, same, kept or conflict; an allowed conflict is updated and its old digest held.

    Both tables are path, sha256 with one row a path.
    """
    both = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    differs = F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "kept").when(differs, "updated" if allow_update else "conflict").otherwise("same")
    digest = F.coalesce("now", "was") if allow_update else F.coalesce("was", "now")
    return both.select("path", digest.alias("sha256"), status.alias("status"), F.when(differs & F.lit(allow_update), F.col("was")).alias("superseded"))


def revisions(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, kind): rows of two pulls that were added, removed or changed; null values equal each other."""
    a = before.select(*keys, F.struct(*values).alias("a"))
    b = after.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")


def quote_direction(rates: DataFrame, lo: float, hi: float) -> DataFrame:
    """Whether a rate lies in its band, or its reciprocal does, by row: ok, inverted or out."""
    inverse = F.try_divide(F.lit(1.0), F.col("fx"))
    return rates.withColumn("direction", F.when(F.col("fx").between(lo, hi), "ok").when(inverse.between(lo, hi), "inverted").otherwise("out"))


def pooled_scores(predictions: DataFrame, key: str) -> DataFrame:
    """Scores of predictions(key, x, y, guess) by ``key`` and pooled over all, from one pass over grouping sets.

    The sign is that of the move from ``x``; rows without a move don't count for it.
    """
    error = F.pow(F.col("y") - F.col("guess"), 2)
    hit = F.when(F.col("y") != F.col("x"), (F.signum(F.col("guess") - F.col("x")) == F.signum(F.col("y") - F.col("x"))).cast("double"))
    sets = predictions.groupingSets([[key], []], key)
    out = sets.agg(F.grouping(key).cast("boolean").alias("pooled"), F.count("*").alias("n"), F.sqrt(F.avg(error)).alias("rmse"), (1 - F.try_divide(F.sum(error), F.var_pop("y") * F.count("*"))).alias("r2"), F.avg(hit).alias("sign_hit"))
    return out.withColumn(key, F.when(F.col("pooled"), "pooled").otherwise(F.col(key)))
