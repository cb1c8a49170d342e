"""Queries of approval blocks and line rules, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import notes as N
from twinleg.plans.panel import rounded
from twinleg.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Words of the derived texts that stand for names, and what counts as forbidden or as a citation there.
NAMES = ["Eriner", "Erachtz", "License", "Ofonrereer"]
FORBIDDEN = r"(?i)\b(password|secret|without|notice)\b"
CITATION = r"(?i)(https?://|\b(19|20)[0-9]{2}-[0-9][0-9]-[0-9][0-9]\b|dated [0-9]{4}|version [0-9])"
DISCLOSURES = {"licence": (["license"], ["copyright", "permission"]), "secret": (["password", "api_key"], ["example"])}


def _add(name: str, query, body: str) -> None:
    QUERIES[name], ORACLES[name] = query, body


def _signed(s, d):
    """Whole texts, each followed by an approval block of its source and language; every third has a blank line inside."""
    value = F.element_at(F.array(*map(F.lit, ["yes", "no", "TODO", "yes", "yes"])), (F.col("doc_id") % 5 + 1).cast("int"))
    gap = F.when(F.col("doc_id") % 3 == 0, "\n \n").otherwise("\n")
    block = F.concat(F.lit("\nsource: "), "source", F.lit("_"), "lang", F.lit("_feed "), gap, F.lit("approved:  "), value, F.lit("\n"))
    return read(s, d, "documents").where("source is not null and lang is not null").select("doc_id", F.concat(F.coalesce("text", F.lit("")), block).alias("text"))


_SIGNED = """
signed AS (
  SELECT doc_id, coalesce(text, '') || chr(10) || 'source: ' || source || '_' || lang || '_feed ' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' || chr(10) ELSE chr(10) END
    || 'approved:  ' || ['yes', 'no', 'TODO', 'yes', 'yes'][CAST(doc_id % 5 + 1 AS INT)] || chr(10) AS text
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
cut AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS v FROM signed),
lines AS (SELECT doc_id, unnest(v) AS v, generate_subscripts(v, 1) AS line FROM cut),
paired AS (
  SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY line) AS following FROM lines WHERE regexp_matches(v, '[^\\x20\\x09-\\x0D]')),
blocks AS (
  SELECT doc_id, line, regexp_extract(v, '^source:[\\x20\\x09-\\x0D]*([a-z0-9_]+)[\\x20\\x09-\\x0D]*$', 1) AS source,
    regexp_extract(following, '^approved:[\\x20\\x09-\\x0D]*([^\\x20\\x09-\\x0D]+)', 1) AS approved
  FROM paired
  WHERE regexp_matches(v, '^source:[\\x20\\x09-\\x0D]*[a-z0-9_]+[\\x20\\x09-\\x0D]*$') AND regexp_matches(following, '^approved:[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]'))"""
_KNOWN = """,
known AS (
  SELECT source, CASE WHEN arg_max(approved, (doc_id, line)) IN ('yes', 'no') THEN arg_max(approved, (doc_id, line)) ELSE 'pending' END AS status, count(*) AS blocks
  FROM blocks GROUP BY 1)"""
_blocks = lambda s, d: N.approval_blocks(_signed(s, d))

_add("txt03_approval_blocks", _blocks, f"WITH {_SIGNED} SELECT * FROM blocks")
_add("txt03_approvals", lambda s, d: N.approvals(_blocks(s, d)), f"WITH {_SIGNED}{_KNOWN} SELECT * FROM known")


def _requests(s, d):
    """Each document's feed: even ones as written, the others under a key of another form."""
    right = F.concat_ws("_", "source", "lang", F.lit("feed"))
    wrong = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Prices-"), "source")).otherwise(F.concat(F.lit("unheard_"), "lang"))
    return read(s, d, "documents").where("source is not null and lang is not null").select("doc_id", F.when(F.col("doc_id") % 2 == 0, right).otherwise(wrong).alias("source"))


_REQUESTS = """,
requests AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '_' || lang || '_feed' WHEN doc_id % 4 = 1 THEN 'Prices-' || source ELSE 'unheard_' || lang END AS source
  FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"""
_add("txt03_request_status", lambda s, d: N.approval_status(_requests(s, d), N.approvals(_blocks(s, d))),
     f"""WITH {_SIGNED}{_KNOWN}{_REQUESTS},
asked AS (SELECT DISTINCT source FROM requests)
SELECT source, coalesce((SELECT status FROM known k WHERE k.source = a.source), 'pending') AS status, source IN (SELECT source FROM known) AS known,
  CASE WHEN source IN (SELECT source FROM known) THEN '' ELSE coalesce((SELECT string_agg(k.source, ',' ORDER BY k.source) FROM known k
    WHERE list_has_any(list_filter(string_split(replace(lower(a.source), '-', '_'), '_'), lambda t: length(t) > 2), string_split(lower(k.source), '_'))), '') END AS near
FROM asked a""")
_add("txt03_gate", lambda s, d: N.approved_only(_requests(s, d), N.approvals(_blocks(s, d))),
     f"WITH {_SIGNED}{_KNOWN}{_REQUESTS} SELECT doc_id, source FROM requests WHERE source IN (SELECT source FROM known WHERE status = 'yes')")

_HAS = lambda column, phrases: "(" + " OR ".join(f"contains(lower({column}), '{p.lower()}')" for p in phrases) + ")"
_add("txt02_line_findings", lambda s, d: N.line_findings(read(s, d, "documents"), NAMES, FORBIDDEN, CITATION),
     f"""WITH cut AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS v FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(v) AS v, generate_subscripts(v, 1) AS line FROM cut),
named AS (SELECT *, regexp_replace(v, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS bare FROM lines WHERE {_HAS("v", NAMES)})
SELECT doc_id, line, 'forbidden' AS rule FROM named WHERE regexp_matches(v, '{FORBIDDEN}')
UNION ALL SELECT doc_id, line, 'uncited' FROM named
WHERE NOT (starts_with(bare, '#') OR starts_with(bare, '>') OR starts_with(bare, '|---') OR length(bare) < 40) AND NOT regexp_matches(v, '{CITATION}')""")
_add("txt02_undisclosed", lambda s, d: rounded(N.undisclosed(read(s, d, "documents"), DISCLOSURES)),
     " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule FROM documents WHERE {_HAS('text', said)} AND NOT {_HAS('text', owed)}" for rule, (said, owed) in DISCLOSURES.items()))
