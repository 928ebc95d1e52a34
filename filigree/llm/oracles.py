"""DuckDB SQL for the queries that SQL can express, whole tables included."""
from __future__ import annotations

from filigree.llm.licenses import TEMPLATES

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
     b AS MATERIALIZED (SELECT item_id, {WORDS} AS ws FROM benchmark),
     masks(m, o) AS (VALUES (0, [0, 1, 3, 4, 7, 9]), (1, [0, 1, 2, 5, 8, 9]), (2, [0, 1, 4, 6, 7, 9])),
     dp AS (SELECT doc_id, unnest(range(len(ws) - 9)) AS p, ws FROM d WHERE len(ws) >= 10),
     bp AS (SELECT item_id, unnest(range(len(ws) - 9)) AS p, ws FROM b WHERE len(ws) >= 10),
     dk AS (SELECT doc_id, p, m, list_transform(o, lambda x: ws[p + x + 1]) AS k FROM dp, masks),
     bk AS (SELECT item_id, p, m, list_transform(o, lambda x: ws[p + x + 1]) AS k FROM bp, masks),
     shifts AS (SELECT DISTINCT doc_id, item_id, dk.p - bk.p AS s FROM dk JOIN bk USING (m, k)),
     same AS (SELECT doc_id, item_id, s, i FROM (
                SELECT doc_id, item_id, s, d.ws AS dw, b.ws AS bw, unnest(range(len(b.ws))) AS i
                FROM shifts JOIN d USING (doc_id) JOIN b USING (item_id))
              WHERE i + s >= 0 AND dw[i + s + 1] = bw[i + 1]),
     found AS (SELECT doc_id, item_id, count(DISTINCT i) AS n_matched FROM same GROUP BY ALL),
     starts AS (SELECT doc_id, item_id, min(greatest(s, 0)) AS start FROM shifts GROUP BY ALL)
SELECT doc_id, item_id, start, n_matched, len(b.ws) AS item_words, round(n_matched / len(b.ws), 6) AS coverage
FROM found JOIN starts USING (doc_id, item_id) JOIN b USING (item_id)
WHERE n_matched >= 0.6 * len(b.ws)
"""

#: Every later line against every earlier one that shares its beginning or its end; the
#: deletion variants of the query have no part in it.
LINES = r"""
WITH split AS (
       SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body,
              unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
     worded AS (SELECT doc_id, line, body,
                       list_filter(regexp_split_to_array(lower(body), '\s+'), lambda w: w <> '') AS ws FROM split),
     firsts AS MATERIALIZED (
       SELECT ws, len(ws) AS n, min(doc_id * 1000000 + line) AS f FROM worded WHERE len(ws) > 0 GROUP BY ws),
     ends AS (
       SELECT ws, n, f, 0 AS side, ws[1:4] AS k FROM firsts WHERE n >= 8
       UNION ALL SELECT ws, n, f, 1, ws[-4:] FROM firsts WHERE n >= 8),
     pairs AS (
       SELECT DISTINCT y.ws AS late, y.f, x.ws AS early FROM ends x JOIN ends y USING (side, k)
       WHERE x.f < y.f AND abs(x.n - y.n) <= 1),
     cut AS (
       SELECT late, f, CASE WHEN len(early) <= len(late) THEN early ELSE late END AS a,
              CASE WHEN len(early) <= len(late) THEN late ELSE early END AS b FROM pairs),
     differ AS (SELECT *, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])), len(a) + 1) AS i FROM cut),
     beaten AS (
       SELECT DISTINCT f FROM differ
       WHERE a[i + 1:] = b[i + 1:] AND len(a) = len(b) OR len(a) + 1 = len(b) AND a[i:] = b[i + 1:]),
     stay AS (SELECT f FROM firsts ANTI JOIN beaten USING (f)),
     told AS (
       SELECT doc_id, line, body, len(ws) > 0 AS worded,
              len(ws) = 0 OR doc_id * 1000000 + line IN (SELECT f FROM stay) AS kept FROM worded),
     texts AS (
       SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
              coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (kept), '') AS kept_text
       FROM told GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept_text) AS kept_chars, md5(kept_text) AS kept_md5 FROM texts
"""

LINKS = f"""
WITH RECURSIVE
  d AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
  sh AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
      SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                          ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS ss
      FROM d WHERE len(ws) > 0) CROSS JOIN unnest(ss) AS u(s)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS MATERIALIZED (
    SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc_id, (SELECT min(y) FROM reach WHERE x = doc_id) AS class_id,
       (SELECT count(*) FROM link WHERE x = doc_id) AS n_links
FROM d
"""

KNOWN = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
GRAMS = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"

LICENSES = rf"""
WITH t AS MATERIALIZED (
       SELECT template, license, {GRAMS} AS g FROM (
         SELECT template, license, {WORDS} AS ws FROM (VALUES {KNOWN}) AS v(template, license, text))),
     parts AS (
       SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS body,
              regexp_split_to_array(coalesce(text, ''), '
[ 	
]*
') AS ps FROM documents),
     every AS (SELECT doc_id, list_concat(ls, CASE WHEN len(ps) > 1 THEN ps ELSE [] END, CASE WHEN len(ls) > 1 THEN [body] ELSE [] END) AS us FROM parts),
     units AS (SELECT doc_id, unnest(us) AS text, unnest(range(len(us))) AS unit FROM every),
     own AS (SELECT doc_id, unit, {GRAMS} AS g FROM (SELECT doc_id, unit, {WORDS} AS ws FROM units) WHERE len(ws) > 1),
     og AS (SELECT doc_id, unit, len(g) AS s, unnest(g) AS gram FROM own),
     tg AS (SELECT template, license, len(g) AS t, unnest(g) AS gram FROM t),
     dice AS (
       SELECT doc_id, license, unit, 2 * count(*) / (s + t) AS d
       FROM og JOIN tg USING (gram) GROUP BY doc_id, unit, s, template, license, t)
SELECT doc_id, license, round(max(d), 6) AS dice, count(DISTINCT unit) AS n_units, min(unit) AS first_unit
FROM dice WHERE d >= 0.8 GROUP BY doc_id, license
"""

#: All occurrences, counted by brute force; products are 128-bit integers.
COLLOCATIONS = r"""
WITH pieces AS (
       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
       FROM documents),
     words AS MATERIALIZED (
       SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
     sizes AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
     grams AS (
       SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
       FROM words, (VALUES (1), (2), (3)) AS v(k) WHERE len(ws) >= k),
     f AS MATERIALIZED (SELECT lang, k, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
     heads AS MATERIALIZED (
       SELECT lang, g, k, f AS a, cut, g[:cut] AS head, g[cut + 1:] AS rest FROM f, (VALUES (1), (2)) AS v(cut) WHERE k > cut),
     cuts AS (
       SELECT h.lang, h.g, h.k, a, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
       FROM heads h JOIN f x ON x.lang = h.lang AND x.g = head JOIN f y ON y.lang = h.lang AND y.g = rest),
     scored AS (
       SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
     around AS (
       SELECT lang, g, max(f) AS around FROM (
         SELECT lang, g[:2] AS g, f FROM f WHERE k = 3 UNION ALL SELECT lang, g[2:], f FROM f WHERE k = 3) GROUP BY ALL),
     free AS (
       SELECT s.* FROM scored s LEFT JOIN around USING (lang, g) WHERE k = 3 OR around IS NULL OR 100 * around < 50 * a),
     ranked AS (
       SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
              row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM free)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_dice_license_scan": LICENSES,
    "op3_spaced_seed_contamination": CONTAMINATION,
    "op7_chosen_path_jaccard": LINKS,
    "op8_deletion_line_dedup": LINES,
    "op11_dynamic_collocations": COLLOCATIONS,
}
