"""DuckDB SQL for the queries whose results SQL can express."""

_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NULL OR d.page_id IS NULL OR d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first IS NULL OR d.page_id IS NULL OR d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
pairs AS (
  SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
  FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT p, q FROM pairs WHERE 100 * i >= 90 * (n + m - i)),
both_ways AS (SELECT p, q FROM e UNION SELECT q, p FROM e),
reach AS (SELECT doc_id AS d, doc_id AS r FROM g UNION SELECT reach.d, both_ways.q FROM reach JOIN both_ways ON reach.r = both_ways.p)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY 1) c ON g.doc_id = c.d
"""

_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, e.q FROM reach JOIN e ON reach.r = e.p),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY 1),
k AS (SELECT p, count(*) AS n FROM e GROUP BY 1)
SELECT embeddings.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, embeddings.vec_id = c.component_id AS kept
FROM embeddings JOIN c ON embeddings.vec_id = c.d LEFT JOIN k ON k.p = embeddings.vec_id
"""

_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

def _way(c: str, a: str, o: str) -> str:
    return f"{{'c': {c}, 'a': {a}, 'o': {o}}}"


def _first(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _inserted(w: str, role: str) -> str:
    return _way(f"{w}.c + 5", f"{w}.a || 'I'", f"list_append({w}.o, '{role}:')")


def _kept(w: str, allowed: str) -> str:
    return _way(f"{w}.c + CASE WHEN fault < 2 AND {allowed} THEN CASE WHEN fault = 1 THEN 5 ELSE 0 END ELSE 1000000000 END", f"{w}.a || 'K'", f"list_append({w}.o, role || ':' || text)")


def _reroled(w: str, role: str) -> str:
    return _way(f"{w}.c + CASE WHEN fault < 2 THEN CASE WHEN fault = 1 THEN 6 ELSE 1 END ELSE 1000000000 END", f"{w}.a || 'R'", f"list_append({w}.o, '{role}:' || text)")


def _deleted(w: str) -> str:
    return _way(f"{w}.c + 2", f"{w}.a || 'D'", f"{w}.o")


_OPEN = ["w0", "w1", _first("w2", _inserted("w0", "user"), _inserted("w1", "user"), _inserted("w3", "user")), "w3"]
_NONE = _way("CAST(1000000000 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")
_REPAIR = rf"""
WITH RECURSIVE polynomial AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (
  SELECT named.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, polynomial),
damaged AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS key, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faulty AS (
  SELECT key, i, turn, role, text, role[1] AS s, lag(role[1]) OVER (PARTITION BY key ORDER BY i) || role[1] AS two,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN nth > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS fault FROM placed),
counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY 1),
ids AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS key FROM conversations),
ways AS (
  SELECT key, CAST(0 AS BIGINT) AS i, {_way("CAST(0 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")} AS w0, {_NONE} AS w1, {_NONE} AS w2, {_NONE} AS w3 FROM ids
  UNION ALL
  SELECT key, i, {_deleted("w0")}, {_first(_deleted("w1"), _kept("w0", "s = 's'"))},
    {_first(_deleted("w2"), *(_kept(w, "s = 'u'") for w in ("w0", "w1", "w3")), *(_reroled(w, "user") for w in ("w0", "w1", "w3")))},
    {_first(_deleted("w3"), _kept("w2", "s = 'a'"), _reroled("w2", "assistant"))}
  FROM (SELECT key, i, role, text, s, fault, w0, w1, {_first("w2", _inserted("w3", "user"))} AS w2, {_first("w3", _inserted("w2", "assistant"))} AS w3
        FROM (SELECT ways.key, faulty.i, role, text, s, fault, w0, w1, {_OPEN[2]} AS w2, {_first("w3", _inserted("w2", "assistant"))} AS w3 FROM ways JOIN faulty ON ways.key = faulty.key AND faulty.i = ways.i + 1))),
ended AS (
  SELECT key, i, list_sort([w0, w3, {_inserted("w2", "assistant")}, {_inserted(_inserted("w1", "user"), "assistant")}])[1] AS w FROM ways)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  w.c AS cost, w.a AS audit, sha256(array_to_string(w.o, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN counted USING (key) JOIN ended ON ended.key = ids.key AND ended.i = coalesce(n, 0)
"""

_REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN f USING (k) WHERE doc_id > first),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)
"""

ORACLES = {"op12_substring_dedup": _REPEATS, "op11_conversation_repair": _REPAIR, "op13_hard_negatives": _NEGATIVES, "op4_warc": _WARC, "op8_jaccard_join": _JACCARD, "op9_embedding_dedup": _VECTORS}
