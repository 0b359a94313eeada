"""DuckDB SQL of the queries that SQL can express whole."""

from __future__ import annotations

from spendscope.llm.mixing import WINDOW
from spendscope.llm.repetition import BASE_PERCENT, BASE_WINDOW, MOST_DUPLICATE_LINE_COUNT, MOST_DUPLICATE_LINES, MOST_REPEATED, SHORTEST

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"

REPETITION = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM w CROSS JOIN (VALUES {", ".join(f"({n})" for n in sorted({BASE_WINDOW, *MOST_REPEATED}))}) v(n))),
twice AS (SELECT doc_id, n, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
places AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM twice),
marked AS (
  SELECT p.doc_id, p.n, count(*) AS n_marked, sum(length(w.ws[p.p])) AS chars
  FROM places p JOIN w ON p.doc_id = w.doc_id GROUP BY p.doc_id, p.n),
lines AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS parts FROM w))
  WHERE regexp_matches(parts[i], '{_WORD}')),
n_lines AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
again AS (SELECT doc_id, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1),
duplicate_lines AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '{_SPACE}', '', 'g'))) AS chars FROM again GROUP BY doc_id),
over AS (
  SELECT m.doc_id, bool_or({" OR ".join(f"(m.n = {n} AND m.chars / greatest(length(regexp_replace(w.t, '{_SPACE}', '', 'g')), 1) > {limit}::double)" for n, limit in MOST_REPEATED.items())}) AS bad
  FROM marked m JOIN w ON m.doc_id = w.doc_id GROUP BY m.doc_id),
counts AS (
  SELECT w.doc_id, len(w.ws)::bigint AS n_words, length(regexp_replace(w.t, '{_SPACE}', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(d.n, 0)::bigint AS n_dup_lines,
    coalesce(d.chars, 0) AS line_chars, coalesce(l.n, 0) AS n_lines, coalesce(m.n_marked, 0)::bigint AS n_repeat_words, coalesce(o.bad, false) AS bad
  FROM w LEFT JOIN duplicate_lines d ON w.doc_id = d.doc_id LEFT JOIN over o ON w.doc_id = o.doc_id LEFT JOIN n_lines l ON w.doc_id = l.doc_id
    LEFT JOIN marked m ON w.doc_id = m.doc_id AND m.n = {BASE_WINDOW})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {SHORTEST} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {SHORTEST} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words OR bad
       OR line_chars / greatest(word_chars, 1) > {MOST_DUPLICATE_LINES}::double OR n_dup_lines > {MOST_DUPLICATE_LINE_COUNT} * n_lines) AS kept
FROM counts
"""

WARC = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::bigint AS n FROM pages),
f AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""

MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint AS size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12))::bigint AS place FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size, count(*) AS n_docs,
    ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::double AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - 3.0::double * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source))),
t AS (
  SELECT source, source_size, n_docs, least(3.0::double * source_size, weight * coalesce(
      max(CASE WHEN weight * level <= 3.0::double * source_size THEN level END) OVER (), 'infinity'::double)) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 1 END::bigint AS base FROM t),
n AS (SELECT *, target - base * source_size AS need FROM b),
u AS (
  SELECT n.source, n.need, n.n_docs, d.place, sum(d.size) AS words, sum(sum(d.size)) OVER (PARTITION BY n.source ORDER BY d.place) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source WHERE d.size > 0 AND n.need > 1e-9 * (n.target + 1)
  GROUP BY n.source, n.need, n.n_docs, d.place),
e AS (
  SELECT source, place - {WINDOW // 2 * (1 << 48)} // n_docs AS low, place + {WINDOW // 2 * (1 << 48)} // n_docs + 1 AS high
  FROM u WHERE upto >= need AND upto - words < need),
i AS (
  SELECT u.*, e.low, e.high, row_number() OVER (PARTITION BY u.source ORDER BY u.words DESC, u.place) AS turn,
    u.need - coalesce((SELECT sum(words) FROM u v WHERE v.source IS NOT DISTINCT FROM u.source AND v.place < e.low), 0) AS room
  FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source WHERE u.place >= e.low AND u.place < e.high),
f AS (
  SELECT source, turn, place, words <= room AS taken, room - CASE WHEN words <= room THEN words ELSE 0 END AS room FROM i WHERE turn = 1
  UNION ALL
  SELECT i.source, i.turn, i.place, i.words <= f.room, f.room - CASE WHEN i.words <= f.room THEN i.words ELSE 0 END
  FROM f JOIN i ON i.source IS NOT DISTINCT FROM f.source AND i.turn = f.turn + 1),
c AS (
  SELECT d.doc_id, d.size, n.source_size, n.target,
    n.base + CASE WHEN d.place < e.low OR (d.place < e.high AND coalesce(f.taken, false)) THEN 1 ELSE 0 END AS copies
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
    LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.place = f.place)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
over AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM over) GROUP BY doc_id),
kept AS (
  SELECT k.doc_id, string_agg(ws[p], ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) k
    LEFT JOIN (SELECT doc_id, unnest(ps) AS p, true AS gone FROM gone) x USING (doc_id, p) WHERE gone IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(len(ps), 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p CROSS JOIN range(1, 6) v(k))),
f AS (SELECT lang, k, phrase, count(*)::bigint AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE a >= 100),
inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, a
  FROM (SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS i FROM c CROSS JOIN range(2, 5) v(j) WHERE j < k)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n.n, x.cut, l.a AS l, r.a AS r, (1000 * c.a::hugeint * n.n // (l.a::hugeint * r.a))::bigint AS score
  FROM c CROSS JOIN range(1, 5) x(cut) JOIN n ON c.lang = n.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:x.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[x.cut + 1:], ' ')
  WHERE x.cut < c.k AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

AUDIT = rf"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, count(*) AS n,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g AS (
  SELECT f.*, filter_order, coalesce(list_min(list_transform(regexp_extract_all(fails, '.'), lambda z: instr(filter_order, z))), 6) AS gone FROM f CROSS JOIN o),
s AS (
  SELECT part, filter_order, step::int AS step, sum(CASE WHEN gone > step THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN gone = step THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN gone = step THEN n * good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN gone = step THEN n * toxic ELSE 0 END)::bigint AS toxic_lost
  FROM g CROSS JOIN range(1, 6) r(step) GROUP BY part, filter_order, step)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::bigint AS shapley FROM s
"""
