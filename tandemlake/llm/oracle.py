"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal FROM s
), f AS (
  SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) <= w * (goal - coalesce(sum(cap) OVER b, 0)) AS is_full
  FROM w WINDOW b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, goal, place, CASE WHEN is_full THEN cap ELSE
    w * (goal - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM f
), c AS (
  SELECT *, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cum, greatest(1, ceil(goal / 65536))::BIGINT AS block FROM t
), b AS (
  SELECT *, ceil(cum / goal * 131072)::BIGINT AS lo, least(ceil((cum + target) / goal * 131072), 131072)::BIGINT AS hi, ceil(round(target) / block)::BIGINT AS wanted FROM c
), k AS (
  SELECT source, block, wanted, list_sum(list_transform(range(17), lambda x: ((i >> x) & 1) << (16 - x)))::BIGINT AS position FROM b, unnest(range(lo, hi)) AS u(i)
), n AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS block_no, wanted, position FROM k
), slots AS (
  SELECT source, block_no, position FROM n WHERE block_no < wanted
  UNION ALL SELECT source, i, i + 131072 FROM b, unnest(range(greatest(hi - lo, 0), wanted)) AS u(i)
), p AS (
  SELECT d.*, row_number() OVER () AS row_id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d
), e AS (
  SELECT p.row_id, p.source, c.block, pos + epoch * source_size AS a, least(pos + epoch * source_size + size, round(target)::BIGINT) AS z
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source, (VALUES (0), (1)) AS v(epoch)
), x AS (
  SELECT row_id, source, a, z, block, i FROM e, unnest(range(a // block, (z - 1) // block + 1)) AS u(i) WHERE z > a
), y AS (
  SELECT row_id, sum(least(z, (i + 1) * block) - greatest(a, i * block))::BIGINT AS taken, min(position)::BIGINT AS first_slot, count(*)::BIGINT AS n_pieces
  FROM x JOIN slots ON x.source IS NOT DISTINCT FROM slots.source AND x.i = slots.block_no GROUP BY row_id
)
SELECT p.doc_id, p.size, p.source, c.source_size, c.target, coalesce(y.taken, 0) AS taken, y.first_slot, coalesce(y.n_pieces, 0) AS n_pieces
FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source LEFT JOIN y USING (row_id)
"""

NGRAMS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w
), n AS (SELECT doc_id, len(gs)::BIGINT AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(gs) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n_shingles + y.n_shingles - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n_shingles, min(r.other) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, parts[i] AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
), w AS (
  SELECT *, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l
), g AS (
  SELECT doc_id, line, t, doc_id * 1000000 + line AS place, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS gs FROM w
), k AS (SELECT *, md5(array_to_string(gs, chr(1))) AS key FROM g),
c AS (SELECT key, min(place) AS first, any_value(gs) AS gs, len(any_value(gs)) AS n FROM k WHERE len(gs) > 0 GROUP BY key),
e AS (SELECT key, first, n, unnest(gs) AS x FROM c),
p AS (SELECT a.key, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND b.first < a.first GROUP BY a.key, b.key),
gone AS (SELECT DISTINCT key FROM p WHERE 100 * m >= 75 * (na + nb - m)),
r AS (SELECT k.*, len(k.gs) > 0 AND (k.key IN (SELECT key FROM gone) OR k.place <> c.first) AS cut FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (cut)::BIGINT AS n_removed, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (cut), '') AS removed,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT cut), '')) AS text_sha256
FROM r GROUP BY doc_id
"""

CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 10 + 1)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT row_id, {rank} AS rank, '{kind}' AS kind, i, m[i] AS whole, g[i] AS part,
    list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT row_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS b FROM d), unnest(range(1, len(m) + 1)) AS u(i)
  WHERE length(g[i]) >= {least}"""


def secrets_sql() -> str:
    from .secrets import RULES

    each = " UNION ALL ".join(_spans(r.kind, k, ("(?i)" if r.any_case else "") + r.pattern, r.group, r.least) for k, r in enumerate(RULES))
    said = "kind || ':' || start::BIGINT || ':' || (start + length(whole))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), s AS ({each}
), a AS (
  SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg({said}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({said}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row_id)
"""
