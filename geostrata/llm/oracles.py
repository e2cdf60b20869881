"""Equivalent SQL of the queries that SQL can express."""

from __future__ import annotations

from geostrata.llm.secret_scan import BASE, RULES


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Positions from the lengths of the pieces between matches and of the matches."""
    arms = []
    for i, r in enumerate(RULES):
        p = _literal(r.pattern)
        arms.append(f"""
SELECT rid, {i} AS ord, '{r.kind}' AS kind, unnest(range(1, len(hits) + 1)) AS k, gaps, hits, judged, {r.least} AS least
FROM (SELECT rid, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS hits,
             regexp_extract_all(text, {p}, {r.group}) AS judged FROM d)""")
    counts = ",\n       ".join(f"CAST(COALESCE(SUM(CASE WHEN ord = {i} THEN 1 END), 0) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(arms)}),
s AS (SELECT rid, ord, kind, list_sum([length(x) for x in gaps[1:k]]) + COALESCE(list_sum([length(x) for x in hits[1:k - 1]]), 0) AS a,
             length(hits[k]) AS n FROM m WHERE length(judged[k]) >= least),
t AS (SELECT rid, ord, a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR) AS span FROM s)
SELECT d.doc_id, {counts},
       sha256(COALESCE(string_agg(span, ',' ORDER BY a, ord) FILTER (WHERE ord < {len(BASE)}), '')) AS base_sha256,
       COALESCE(string_agg(span, ',' ORDER BY a, ord), '') AS spans
FROM d LEFT JOIN t ON t.rid = d.rid GROUP BY d.rid, d.doc_id"""


_GOOD = """
SELECT vec_id, label, embedding FROM embeddings
WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""

_EMBEDDINGS = f"""
WITH RECURSIVE good AS ({_GOOD}),
e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM good WHERE label IS NOT NULL),
u AS (SELECT vec_id, label, v, sqrt(list_sum([x * x for x in v])) AS n FROM e),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT g.vec_id, CAST((SELECT COUNT(*) FROM p WHERE p.a = g.vec_id) AS BIGINT) AS n_links,
       LEAST(g.vec_id, COALESCE((SELECT MIN(b) FROM r WHERE r.a = g.vec_id), g.vec_id)) AS component_id,
       g.vec_id <= COALESCE((SELECT MIN(b) FROM r WHERE r.a = g.vec_id), g.vec_id) AS kept
FROM embeddings g"""

_TOPK = f"""
WITH good AS ({_GOOD}),
w AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM good),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM w q JOIN w c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES = {"op5_embedding_dedup": _EMBEDDINGS, "op7_secrets": _secrets(), "op10_topk": _TOPK}

# reads a checksum's bits one by one; repairs by carrying whole strings forward, state by state
_REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
cases AS (
  SELECT *, xor(list_reduce([4294967295] || flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(key, '')]),
                lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS k FROM keyed),
dealt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM cases WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dealt),
judged AS (
  SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'fine' END AS fault FROM placed),
emits(s, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
more(s, t, letters, names) AS (VALUES
  (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
  (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
ways AS (
  SELECT s, 'D' AS letter, s AS t, NULL AS x, 2 AS cost FROM (VALUES (0), (1), (2), (3)) v(s)
  UNION ALL SELECT s, 'K', t, x, 0 FROM emits
  UNION ALL SELECT s, 'R', t, x, 1 FROM emits WHERE x <> 's'),
walk AS (
  SELECT conv_id, 0 AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM placed WHERE i = 1
  UNION ALL
  SELECT conv_id, i, t, best.cost, best.audit, best.said FROM (
    SELECT w.conv_id, j.i, y.t, min(struct_pack(
             cost := w.cost + 5 * length(m.letters) + y.cost + CASE WHEN j.fault = 'truncated' AND y.letter <> 'D' THEN 5 ELSE 0 END,
             audit := w.audit || m.letters || y.letter,
             said := w.said || m.names || CASE y.letter WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text]
                                          ELSE [CASE y.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END)) AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
    JOIN more m ON m.s = w.s JOIN ways y ON y.s = m.t
    WHERE y.letter = 'D' OR (j.fault IN ('fine', 'truncated') AND (y.letter = 'R' OR y.x = j.ini))
    GROUP BY w.conv_id, j.i, y.t)),
ended AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + 5 * length(m.letters), audit := w.audit || m.letters, said := w.said || m.names)) AS best
  FROM walk w JOIN (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i
  JOIN more m ON m.s = w.s WHERE m.t IN (0, 3) GROUP BY w.conv_id),
counted AS (
  SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, CAST(COALESCE(blank, 0) AS BIGINT) AS blank,
       CAST(COALESCE(duplicate, 0) AS BIGINT) AS duplicate, CAST(COALESCE(truncated, 0) AS BIGINT) AS truncated,
       CAST(COALESCE(illegal, 0) AS BIGINT) AS illegal, CAST(COALESCE(best.cost, 0) AS BIGINT) AS cost,
       COALESCE(best.audit, '') AS audit, sha256(COALESCE(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES["op12_turn_repair"] = _REPAIR

_TERMS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
t AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(CAST(len(terms) AS BIGINT)) AS n, term, count(*) AS tf
      FROM (SELECT rid, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY rid, term),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
q AS (SELECT iid, any_value(item_id) AS item_id, term, count(*) AS times
      FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY iid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (SELECT iid, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY iid, rid),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLES["op13_lexical_search"] = _LEXICAL
