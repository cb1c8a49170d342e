"""PII: information-theoretic sanitisation.  Only DataFrame and SQL functions.

Rules find the protected entities.  For the terms of their texts, corpus counts estimate how strongly a term reveals an entity:
the pointwise mutual information of term and entity against the entity's information content, which is one plus the log of
p(entity | term) over that content.  Both are counted in different texts, wherever in the text a word stands.  Entities of a
single text have no counts of their own that a chance word wouldn't have too: they are judged by their kind (p(kind | term)).
Below SUPPORT shared texts one more text without the entity is assumed.  Terms that reach the disclosure threshold are
further spans, wherever they stand; entities are generalised to their kind, such terms are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written
from .spans import SPAN, matches, quoted, replaced

# The rules, written so that no run of characters is scanned anew from within it and no repeat is taken back,
# which gives the same matches.  Only digits that can make a card are hits of CARD.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9]|[\x20-][0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
KINDS = ["email", "ip", "card", "phone", "term"]

#: Texts with term and entity from which on p(entity | term) is taken as counted, and its least value, which is also the least
#: share of the entity's information content.
SUPPORT, DISCLOSURE = 3, 0.5


def _luhn(digits: str) -> str:
    return f"""(aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + if(i % 2 = 1, int(substring({digits}, -i, 1)),
        (2 * int(substring({digits}, -i, 1))) div 10 + (2 * int(substring({digits}, -i, 1))) % 10)) % 10 = 0)"""


def rule_spans(text: str) -> Column:
    """Spans of the four kinds; matches that fail their test are dropped, not tried again."""
    ip = F.filter(matches(text, IP, "ip"), lambda x: F.forall(F.split(x["hit"], "[.]"), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255)))
    digits = lambda x: F.regexp_replace(x["hit"], "[^0-9]", "")
    cards = F.filter(matches(text, CARD, "card"), lambda x: F.length(digits(x)).between(13, 19))
    phone = F.filter(matches(text, PHONE, "phone", f"contains({text}, '+')"), lambda x: F.length(digits(x)).between(9, 15))
    return F.concat(matches(text, EMAIL, "email", f"contains({text}, '@')"), ip, cards, phone)


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add pii_key (hash of the text) and rule_spans to every row; null texts count as empty."""
    return (
        docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("pii_key", F.xxhash64("pii_text"))
        .withColumn("rule_spans", rule_spans("pii_text"))
        .withColumn("rule_spans", F.expr(f"filter(rule_spans, x -> x.kind <> 'card' or {_luhn("regexp_replace(x.hit, '[^0-9]', '')")})"))
        .drop("pii_text")
    )


def evidence(found: DataFrame) -> DataFrame:
    """(pii_key, held): for each text with entities, what it holds as (key, texts), texts being the different texts that hold it.

    Keys are the kinds, and the entities of two texts or more; entities of the same texts have the same counts and one key.
    """
    spans = found.where("size(rule_spans) > 0").select("pii_key", F.explode("rule_spans").alias("x"))
    own = written(spans.select("pii_key", "x.kind", F.concat("x.kind", F.lit(":"), F.lower("x.hit")).alias("entity")).distinct(), "entities")
    named = own.groupBy("entity").agg(F.bit_xor(F.xxhash64("pii_key")).alias("key"), F.count("*").alias("texts")).where("texts > 1")
    kinds = own.groupBy("kind").agg(F.xxhash64("kind").alias("key"), F.count_distinct("pii_key").alias("texts"))
    rows = own.join(small(written(named, "named")), "entity").select("pii_key", "key", "texts")
    rows = rows.unionAll(own.join(F.broadcast(kinds), "kind").select("pii_key", "key", "texts"))
    return rows.groupBy("pii_key").agg(F.collect_set(F.struct("key", "texts")).alias("held"))


def words_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pii_key, term): the different words of each text, in lower case."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(t).alias("pii_key"), F.explode(F.array_distinct(F.split(F.lower(t), GAP))).alias("term")).where("term <> ''")


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal an entity or a kind, and the texts (pii_key, term) they stand in.  Equal texts count once.

    Terms are counted over whole texts, alone and with each key of their text, by one aggregation that combines before its
    shuffle.  ``reach`` is the largest number of texts at which a term with that many shared ones still discloses, so a term's
    counts are never joined; only terms that pass are looked up in the texts again.
    """
    total = found.select("pii_key").distinct().count()
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.groupBy(F.xxhash64(t).alias("pii_key")).agg(F.first(t).alias("t")).join(small(written(evidence(found), "evidence")), "pii_key", "left")
    rows = rows.select("t", F.explode(F.expr("concat(array(cast(null as struct<key: bigint, texts: bigint>)), coalesce(held, array()))")).alias("k"))
    words = rows.select("k.key", "k.texts", F.explode(F.array_distinct(F.split(F.lower("t"), GAP))).alias("term")).where("term <> ''")
    counts = words.groupBy("term", "key", "texts").agg(F.count("*").alias("n"))
    sure = f"if(n >= {support}, n / {disclosure}D, ceil(n / {disclosure}D) - 2)"
    reach = F.expr(f"if(key is null, null, least({sure}, n / pow(texts / {max(total, 1)}D, 1 - {disclosure}D)))")
    best = counts.groupBy("term").agg(F.max(F.expr("if(key is null, n, null)")).alias("n"), F.max(reach).alias("reach"))
    strong = written(best.where("reach >= n").select("term"), "strong")
    return strong, written(words_of(docs, text).join(small(strong), "term", "left_semi").distinct(), "revealing")


def term_spans(docs: DataFrame, places: DataFrame, text: str = "text") -> DataFrame:
    """(pii_key, term_spans): where the given terms stand, for each different text in ``places``.

    Words are numbered rows and their places running sums of lengths, so the work is linear in a text's length.
    """
    wanted = written(places.groupBy("pii_key").agg(F.collect_set("term").alias("terms")), "wanted")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("pii_key"), t.alias("pii_text")).join(small(wanted), "pii_key")
    rows = rows.groupBy("pii_key").agg(F.first("pii_text").alias("pii_text"), F.first("terms").alias("terms"))
    hits, gaps = F.expr(f"regexp_extract_all(pii_text, {quoted(WORD)}, 0)"), F.expr(f"split(pii_text, {quoted(WORD)}, -1)")
    words = rows.select("pii_key", "terms", F.posexplode(F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))).alias("at", "w"))
    end = F.sum(F.length("w.gap") + F.length("w.hit")).over(Window.partitionBy("pii_key").orderBy("at")).cast("int")
    ended = words.select("pii_key", F.array_contains("terms", F.lower("w.hit")).alias("wanted"), "w.hit", end.alias("end")).where("wanted")
    span = F.struct(F.lit("term").alias("kind"), (F.col("end") - F.length("hit")).alias("start"), "end", "hit")
    return ended.groupBy("pii_key").agg(F.sort_array(F.collect_list(span)).cast(SPAN).alias("term_spans"))


def find_personal_data(docs: DataFrame, text: str = "text", keep_text: bool = True, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Add pii_spans to every row: kind (email, ip, card, phone, term), start, end (code points, end exclusive), hit.

    Null and empty texts have no spans; terms that overlap an entity are left out.  Repeated rows stay repeated and count once
    as evidence; columns that clash with the added ones are replaced; an empty table stays empty.  ``keep_text`` false leaves
    the text out of the result and of the tables written on the way.
    """
    docs = docs.drop("pii_spans", "pii_key", "rule_spans", "term_spans", "pii_text")
    found = extract(docs, text)
    kept = written(found if keep_text else found.drop(text), "pii")
    strong, places = disclosing_terms(docs, kept, text, support, disclosure)
    if places.isEmpty():
        return kept.withColumn("pii_spans", F.col("rule_spans").cast(SPAN)).drop("rule_spans", "pii_key")
    more = written(term_spans(docs, places, text), "termspans")
    out = kept.join(small(more), "pii_key", "left")
    return out.withColumn("pii_spans", F.expr(f"concat(rule_spans, coalesce(filter(term_spans, x -> not exists(rule_spans, o -> o.start < x.end and x.start < o.end)), cast(array() as {SPAN})))").cast(SPAN)).drop("rule_spans", "term_spans", "pii_key")


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with entities generalised to [kind] and revealing terms removed; texts without either stay as they are."""
    found = find_personal_data(docs, text)
    mark = "if(x.kind = 'term', '', concat('[', x.kind, ']'))"
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, replaced(text, "pii_spans", mark)).otherwise(F.col(text))).drop("pii_spans")
