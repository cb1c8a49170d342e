"""Secret scans: character Markov models of random strings and ordinary identifiers, compared by log-likelihood ratio.

Only DataFrame and SQL functions.  Plain rules find what is written like a secret.  Their values are the labelled random
strings, long tokens without digits are the labelled ordinary identifiers; both models count adjacent characters over all of
them.  A long token outside the rules' spans whose log-likelihood ratio passes the threshold is a further span.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import SPAN, clear_of, matches, replaced

# The rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]

#: A long token; the models' alphabet; added to every character's count; weight of these shares in the counts of what follows a
#: character, for ordinary and random strings (in the latter characters barely depend on the one before, so pairs seen by chance
#: mustn't count for much); the least log-likelihood ratio (in nats) of a further span.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_=-."
SMOOTH, BACK, LEAST = 0.2, (10.0, 100.0), 10.0


def rule_spans(text: str) -> Column:
    """Spans of the three rules.  A maximal run is taken whole, so a least length inside the pattern drops the same matches."""
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 8)
    return F.concat(assign, matches(text, ACCESS, "access", f"contains({text}, 'AKIA')"), matches(text, HEX, "hex"))


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add rule_spans and token_spans (long tokens clear of them) to every row; null texts have none."""
    return (
        docs.withColumn("scan_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("rule_spans", rule_spans("scan_text"))
        .withColumn("token_spans", matches("scan_text", TOKEN, "markov"))
        .withColumn("token_spans", clear_of("token_spans", "rule_spans"))
        .drop("scan_text")
    )


def samples(found: DataFrame) -> DataFrame:
    """Labelled samples from ``extract``: token, random (1: a rule's value, 0: a long token without digits).

    A corpus often writes its secrets in one alphabet, such as hexadecimal digits.  So that random strings in others are known
    as random too, each value also stands as written in capitals, and its digest in base64, its URL form, letters and digits
    of both cases, and of either case.  Repeated samples count once, so that one secret in many documents doesn't make its own
    characters the model.
    """
    value = F.when(F.col("x.kind") == "assign", F.regexp_extract("x.hit", ASSIGN, 2)).otherwise(F.col("x.hit"))
    values = found.select(F.explode("rule_spans").alias("x")).select(value.alias("v")).distinct()
    mixed = F.rtrim(F.base64(F.unhex(F.sha2("v", 256))), F.lit("="))
    plain = F.regexp_replace(mixed, "[+/]", "")
    forms = values.select("v", mixed.alias("m"), plain.alias("p"))
    secret = forms.select(F.explode(F.array("v", F.upper("v"), "m", F.translate("m", "+/", "-_"), "p", F.lower("p"), F.upper("p"))).alias("token"), F.lit(1).alias("random"))
    ordinary = found.select(F.explode("token_spans").alias("x")).where("not x.hit rlike '[0-9]'").select(F.col("x.hit").alias("token"), F.lit(0).alias("random")).distinct()
    return secret.unionAll(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of adjacent alphabet characters, row by row; its size is fixed by the alphabet.

    Counts cover all samples.  Without samples of a class its model is uniform, so no ratio is large.
    """
    n = len(ALPHABET)
    pairs = labelled.select("random", "token", F.explode(F.expr("sequence(1, greatest(length(token) - 1, 1))")).alias("i"))
    pairs = pairs.select("random", F.expr("substring(token, i, 1)").alias("a"), F.expr("substring(token, i + 1, 1)").alias("b"))
    pairs = pairs.select("random", F.expr(f"instr('{ALPHABET}', a)").alias("a"), F.expr(f"if(b = '', 0, instr('{ALPHABET}', b))").alias("b")).where("a > 0 and b > 0")
    counts = pairs.groupBy("a", "b").agg(F.sum(F.expr("if(random = 1, 1, 0)")).alias("r"), F.sum(F.expr("if(random = 0, 1, 0)")).alias("o"))
    table = [[[0, 0] for _ in range(n)] for _ in range(n)]
    for row in counts.collect():  # at most one row for each pair of alphabet characters
        table[row["a"] - 1][row["b"] - 1] = [row["r"], row["o"]]
    shares = []
    for k in (0, 1):
        column = [sum(line[j][k] for line in table) + SMOOTH for j in range(n)]
        shares.append([x / sum(column) for x in column])
    out = []
    for line in table:
        total = [sum(c[k] for c in line) + BACK[1 - k] for k in (0, 1)]
        out += [round(log((c[0] + BACK[1] * shares[0][j]) / total[0]) - log((c[1] + BACK[0] * shares[1][j]) / total[1]), 9) for j, c in enumerate(line)]
    return out


def ratio(token: str, model: list[float]) -> str:
    """SQL of a token's log-likelihood ratio; characters outside the alphabet add nothing."""
    n = len(ALPHABET)
    array = f"from_json('{[*model]}', 'array<double>')"
    return f"""aggregate(transform(sequence(1, greatest(length({token}) - 1, 1)), i -> struct(instr('{ALPHABET}', substring({token}, i, 1)) as a, instr('{ALPHABET}', substring({token}, i + 1, 1)) as b)),
        0D, (s, p) -> s + if(p.a > 0 and p.b > 0, {array}[(p.a - 1) * {n} + p.b - 1], 0D))"""


def scan(found: DataFrame, model: list[float], least: float = LEAST) -> DataFrame:
    """Turn ``extract``'s columns into secret_spans (array of kind, start, end, hit): the rules' spans and the models'."""
    kept = F.expr(f"filter(token_spans, x -> {ratio('x.hit', model)} >= {least}D)")
    return found.withColumn("secret_spans", F.concat("rule_spans", kept).cast(SPAN)).drop("rule_spans", "token_spans")


def find_secrets(docs: DataFrame, text: str = "text", least: float = LEAST, keep_text: bool = True) -> DataFrame:
    """Add secret_spans to every row of ``docs``: kind, start, end (code points, end exclusive), hit.

    Null and empty texts have no spans.  Rows are kept as they are, repeated ones too, with all other columns (one already
    named secret_spans is replaced).  An empty table trains uniform models and stays empty.  ``keep_text`` false leaves the text
    out of the result and of the table that is written on the way.
    """
    found = extract(docs.drop("secret_spans", "rule_spans", "token_spans", "scan_text"), text)
    found = written(found if keep_text else found.drop(text), "secrets")
    return scan(found, train(samples(found)), least)


def without_secrets(docs: DataFrame, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by [secret]; texts without one stay as they are (null too).

    The column ``count``, if named, is set to the new length of texts that changed.
    """
    found = find_secrets(docs, text)
    hit = F.size("secret_spans") > 0
    found = found.withColumn(text, F.when(hit, replaced(text, "secret_spans", "'[secret]'")).otherwise(F.col(text)))
    if count:
        found = found.withColumn(count, F.when(hit, F.length(text).cast("long")).otherwise(F.col(count)))
    return found.drop("secret_spans")
