"""DuckDB SQL for those corpus queries that SQL can express: they compare whole tables with themselves, or list all spans."""

from __future__ import annotations

from .pii import OCTET, WORD

#: The patterns of the base kinds as the contract states them; the operator uses forms without backtracking.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM starts JOIN d USING (r)),
repeated AS (SELECT r, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
left_over AS (SELECT words.r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept FROM words LEFT JOIN gone USING (r, p) GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)
"""


def _cells(kind: int, pattern: str) -> str:
    """The matches of one pattern in each row, with the lengths that lead to their places."""
    return (
        f"SELECT r, {kind} AS kind, unnest(m) AS m, unnest(g[1 : len(m)]) AS g, generate_subscripts(m, 1) AS i "
        f"FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d)"
    )


OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cells AS ({" UNION ALL ".join(_cells(k, p) for k, p in enumerate((EMAIL, IP, CARD, PHONE, WORD)))}),
ended AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS b, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM cells),
base AS (
  SELECT r, kind, b - length(m) AS a, b, kind || ':' || CASE WHEN kind >= 2 THEN n ELSE lower(m) END AS entity FROM ended
  WHERE kind < 4 AND CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_full_match(m, '{OCTET}(\.{OCTET}){{3}}') WHEN 3 THEN length(n) BETWEEN 9 AND 15
    ELSE length(n) BETWEEN 12 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN x ELSE 2 * x - CASE WHEN x > 4 THEN 9 ELSE 0 END END
      FOR x, k IN [coalesce(try_cast(c AS INT), 0) FOR c IN string_split(reverse(n), '')]]) % 10 = 0 END),
same AS (SELECT min(r) AS first, count(*) AS times FROM d GROUP BY doc_id, text),
once AS (SELECT DISTINCT r, entity, times FROM base JOIN same ON first = r),
entities AS (SELECT entity, sum(times) AS n_e FROM once GROUP BY entity HAVING count(*) >= 3),
terms AS (SELECT DISTINCT r, lower(m) AS term FROM cells WHERE kind = 4),
seen AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
pairs AS (SELECT entity, term, sum(times) AS n_et FROM once JOIN entities USING (entity) JOIN terms USING (r) GROUP BY entity, term HAVING count(*) >= 3),
given AS (
  SELECT entity, term FROM pairs JOIN entities USING (entity) JOIN seen USING (term), (SELECT count(*)::DOUBLE AS n FROM d)
  WHERE n > n_e AND log2(n_et * n / (n_e * n_t)) / log2(n / n_e) >= 0.9),
marks AS (SELECT DISTINCT base.r, given.term FROM base JOIN given USING (entity) JOIN terms ON terms.r = base.r AND terms.term = given.term),
added AS (SELECT e.r, e.kind, e.b - length(e.m) AS a, e.b FROM ended e JOIN marks ON marks.r = e.r AND e.kind = 4 AND lower(e.m) = marks.term),
every AS (
  SELECT r, kind, a, b FROM base UNION ALL
  SELECT r, kind, a, b FROM added t WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = t.r AND base.a < t.b AND t.a < base.b)),
named AS (SELECT r, kind, a, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || a || ':' || b AS s FROM every),
texts AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
    count(*) FILTER (kind = 4) AS n_term, string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 4) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans
  FROM named GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term FROM d LEFT JOIN texts USING (r)
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""


OP11 = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""


def _terms(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT q, item_id, term, times * floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), s),
lengths AS (SELECT r, doc_id, 75 + (25 * len(w) * nd) // l AS m FROM d, s WHERE l > 0),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN lengths USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""

OP13 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hexed, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, 10 * (i // 8)::INT + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
  CASE WHEN page_id > first THEN NULL ELSE true END AS intact FROM h
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6, "op9_personal_data": OP9, "op10_embedding_dedup": OP10, "op11_hard_negatives": OP11, "op12_ranked_search": OP12, "op13_warc": OP13}
