"""Blocks and rules over the lines of texts: source approvals, and what a line that names someone must and mustn't say."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two lines of an approval block, line ends, and what opens a line that claims nothing.
SOURCE = r"^source:[\x20\x09-\x0D]*([a-z0-9_]+)[\x20\x09-\x0D]*$"
APPROVED = r"^approved:[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)"
LINE_END = r"\r\n|\n|\r"
NO_CLAIM = ["#", ">", "|---"]
#: Shortest line that can make a claim, and the least length of a token that keys must share (more than this).
LEAST_LINE, SHORT_TOKEN = 40, 2


def numbered_lines(text: str) -> Column:
    """array<struct<line, v>> of a text's lines, numbered from 1; null texts have none."""
    return F.coalesce(F.transform(F.split(text, LINE_END, -1), lambda v, i: F.struct((i + 1).alias("line"), v.alias("v"))), F.expr("array()").cast("array<struct<line:int,v:string>>"))


def approval_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, source, approved): a ``source:`` line whose next line that isn't blank is an ``approved:`` line.

    ``line`` is that of the source.  Lines meet their successor inside their own text's array, so no text is shuffled.
    Texts that are null, empty or without blocks give no rows; repeated rows of ``docs`` give theirs again.
    """
    full = F.filter(numbered_lines(text), lambda x: x["v"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(key, full.alias("full"))
    pairs = F.zip_with("full", F.slice("full", F.lit(2), F.size("full")), lambda a, b: F.struct(a["line"].alias("line"), a["v"].alias("a"), b["v"].alias("b")))
    blocks = F.filter(pairs, lambda x: x["a"].rlike(SOURCE) & x["b"].rlike(APPROVED))
    found = rows.select(key, F.explode(blocks).alias("x"))
    return found.select(key, F.col("x.line").cast("long").alias("line"), F.regexp_extract("x.a", SOURCE, 1).alias("source"), F.regexp_extract("x.b", APPROVED, 1).alias("approved"))


def approvals(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, status, blocks): the last block of each source by document and line; all but yes and no is pending."""
    last = blocks.groupBy("source").agg(F.max_by("approved", F.struct(key, "line")).alias("approved"), F.count("*").alias("blocks"))
    return last.select("source", F.when(F.col("approved").isin("yes", "no"), F.col("approved")).otherwise("pending").alias("status"), "blocks")


def _tokens(key: str) -> Column:
    return F.array_distinct(F.split(F.lower(key), "_"))


def approval_status(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(source, status, known, near) of every different non-null ``source`` of ``requests``: unknown sources are pending.

    ``near`` lists, by name, the known sources that share a token of more than two characters with an unknown one (hyphens count
    as underscores), as a misspelt approval looks approved to its author.  Both sides are different keys of a hand-kept
    registry; they meet by token, never all with all.
    """
    asked = requests.where("source is not null").select("source").distinct()
    found = asked.join(known.select("source", "status").hint("merge"), "source", "left").withColumn("known", F.col("status").isNotNull())
    words = F.filter(_tokens(F.regexp_replace("source", "-", "_")), lambda t: F.length(t) > SHORT_TOKEN)
    mine = found.where("not known").select("source", F.explode(words).alias("token"))
    theirs = known.select(F.col("source").alias("key"), F.explode(_tokens("source")).alias("token"))
    near = mine.join(theirs.hint("merge"), "token").groupBy("source").agg(F.array_sort(F.collect_set("key")).alias("near"))
    out = found.join(near.hint("merge"), "source", "left")
    return out.select("source", F.coalesce("status", F.lit("pending")).alias("status"), "known", F.coalesce(F.array_join("near", ","), F.lit("")).alias("near"))


def approved_only(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` whose source is approved; a semi-join."""
    return rows.join(known.where("status = 'yes'").select("source").hint("merge"), "source", "left_semi")


def require_approved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows``, failing at the first one whose source isn't approved; a null source isn't."""
    states = known.select("source", "status")
    joined = rows.join(states.hint("merge"), "source", "left")
    why = F.format_string("source %s is %s", F.coalesce("source", F.lit("(none)")), F.coalesce("status", F.lit("pending")))
    return joined.where(F.when(F.coalesce(F.col("status") == "yes", F.lit(False)), True).otherwise(F.raise_error(why).cast("boolean"))).drop("status")


def line_findings(docs: DataFrame, names: list[str], forbidden: str, citation: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, rule) over lines that hold one of ``names`` in either case.

    forbidden: the line matches that pattern.  uncited: it makes a claim and doesn't match ``citation``; headings, quotes, table
    rules and lines under 40 characters claim nothing.  A line can break both rules.
    """
    low = F.lower("x.v")
    named = reduce(or_, (low.contains(n.lower()) for n in names), F.lit(False))
    lines = docs.select(key, F.explode(numbered_lines(text)).alias("x")).where(named)
    bare = F.regexp_replace("x.v", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    claims = ~reduce(or_, (bare.startswith(p) for p in NO_CLAIM), F.length(bare) < LEAST_LINE)
    rules = F.array(F.when(F.col("x.v").rlike(forbidden), "forbidden"), F.when(claims & ~F.col("x.v").rlike(citation), "uncited"))
    return lines.select(key, F.col("x.line").cast("long").alias("line"), F.explode(F.array_compact(rules)).alias("rule"))


def undisclosed(docs: DataFrame, rules: dict[str, tuple[list[str], list[str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule) of texts that hold a phrase of a rule's first list and none of its second, in either case."""
    low = F.lower(text)
    has = lambda phrases: reduce(or_, (low.contains(p.lower()) for p in phrases), F.lit(False))
    broken = F.array(*(F.when(has(said) & ~has(owed), rule) for rule, (said, owed) in rules.items()))
    return docs.select(key, F.explode(F.array_compact(broken)).alias("rule"))
