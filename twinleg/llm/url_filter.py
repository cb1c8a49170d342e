"""URL filters: host and path rules, and for the rest a logistic regression on hashed character n-grams.

Only DataFrame and SQL functions.  The labelled URL table is small: at most SAMPLE_ROWS rows.  Training is full-batch gradient
descent; a step is one aggregation over the table's (url, bucket) rows, and the weights between steps have a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Buckets of the hash, n-gram length, bound on labelled rows, steps, step size, and shrinkage of weights.
BUCKETS, GRAM, SAMPLE_ROWS, STEPS, RATE, SHRINK = 1024, 4, 1000, 15, 8.0, 1e-4

# The rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: str) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.expr(f"translate(regexp_extract(coalesce(substring({url}, nullif(instr({url}, '://'), 0) + 3), ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def path_of(url: str) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.expr(f"regexp_extract(coalesce(substring({url}, nullif(instr({url}, '://'), 0) + 3), ''), '(?s)^[^/?#]*([^?#]*)', 1)")


def rule_for(host: str, path: str, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host, its subdomains and the start of the path; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> Column:
    """Bucket of every character n-gram of the host and path, with marks at their ends."""
    whole = f"concat('^', {host}, '$', {path}, '$')"
    return F.expr(f"transform(sequence(1, greatest(length({whole}) - {GRAM - 1}, 1)), i -> int(pmod(xxhash64(substring({whole}, i, {GRAM})), {BUCKETS})))")


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Weights of the buckets, then the bias, for block.  ``labelled``: host, path, block (0 or 1).

    Its ``sample_rows`` rows of smallest hash are used, repeated ones once; rows with a null are left out.  Without rows all
    weights are zero.
    """
    table = labelled.dropna(subset=["host", "path", "block"]).select("host", "path", F.col("block").cast("int").alias("block")).distinct()
    table = table.select("*", F.xxhash64("host", "path", "block").alias("row")).orderBy("row", "host", "path").limit(sample_rows)
    rows = written(table.select("row", "block", F.explode(F.array_distinct(grams("host", "path"))).alias("bucket")).coalesce(1), "urls")
    n = rows.select("row").distinct().count()
    weights = [0.0] * (BUCKETS + 1)
    for _ in range(STEPS if n else 0):
        w = F.expr(f"from_json('{weights}', 'array<double>')")
        size = F.count("*")
        odds = rows.groupBy("row", "block").agg((F.sum(w[F.col("bucket")]) / F.sqrt(size)).alias("z"), F.collect_list("bucket").alias("buckets"))
        error = odds.select(((1 / (1 + F.exp(-(F.col("z") + weights[-1])))) - F.col("block")).alias("e"), "buckets")
        each = error.select("e", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"), F.sqrt(F.size("buckets")).alias("root"))
        step = each.groupBy("bucket").agg(F.sum(F.when(F.col("bucket") < 0, F.col("e")).otherwise(F.col("e") / F.col("root"))).alias("g"))
        weights = [x * (1 - SHRINK) for x in weights]
        for row in step.collect():  # one row for each bucket at most
            weights[row["bucket"]] = round(weights[row["bucket"]] - RATE * row["g"] / n, 9)
    return weights


def judge(pages: DataFrame, weights: list[float], rules=RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule, score (probability of block) and verdict to every row.

    The longest fitting rule decides; without one, block where the score passes one half.  A null url, or one without ://, has
    an empty host and path.  Columns of these names are replaced; no rows give no rows.
    """
    w = f"from_json('{[*weights[:-1]]}', 'array<double>')"
    return (
        pages.withColumn("host", host_of(url))
        .withColumn("path", path_of(url))
        .withColumn("url_rule", rule_for("host", "path", rules))
        .withColumn("url_grams", F.array_distinct(grams("host", "path")))
        .withColumn("score", F.expr(f"1 / (1 + exp(-({weights[-1]}D + aggregate(url_grams, 0D, (s, b) -> s + {w}[b]) / sqrt(size(url_grams)))))"))
        .withColumn("rule", F.col("url_rule.rule"))
        .withColumn("verdict", F.coalesce("url_rule.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")))
        .drop("url_rule", "url_grams")
    )


def labelled_by_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """The labelled URL table that the rules themselves give: host, path, block."""
    found = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).withColumn("r", rule_for("host", "path", rules))
    return found.where("r is not null").select("host", "path", F.when(F.col("r.verdict") == "block", 1).otherwise(0).alias("block"))


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``judge`` with weights trained on the urls that the rules decide."""
    return judge(pages, train(labelled_by_rules(pages, rules, url)), rules, url)
