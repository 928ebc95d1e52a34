"""SQL with the same results as the registered queries, for a second engine to run.

Written from the definitions, in DuckDB's dialect; nothing here is used by the queries
apart from fixed values (patterns, forms, sizes).
"""
from __future__ import annotations

from filigree.plans.catalog import CITATION_FLOOR, EVIDENCE_COSINE, EVIDENCE_SCORE
from filigree.sources.domain import PRIORITY_FORMS, SELECTION, STATUS_SUFFIXES

ASCII = "[^a-z0-9]+"
UNICODE = r"[^\p{L}\p{N}]+"
WORD = r"[^ \t\n\f\r]+[ \t\n\f\r]*"
BLANK = r"[ \t\r\n\f]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, values: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {_q(default)} END"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _tokens(text: str, breaks: str = ASCII) -> str:
    return f"list_filter(string_split_regex(lower({text}), {_q(breaks)}), lambda w: w <> '')"


# ---- filings --------------------------------------------------------------------

FILINGS = f"""
raw AS (
  SELECT 'C' || o_custkey AS ticker, printf('%010d', o_custkey) AS cik, o_orderkey,
         CAST(o_orderkey // 1000 AS INT) AS page_ord,
         {_case('o_orderpriority', PRIORITY_FORMS, '8-K')} AS form,
         strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(CAST(o_orderdate AS DATE) - 90, '%Y-%m-%d') END AS report_date,
         'd' || o_orderkey || {_case('o_orderstatus', STATUS_SUFFIXES, '')} AS primary_document
  FROM orders),
filings AS (
  SELECT ticker, cik, page_ord,
         CAST(row_number() OVER (PARTITION BY ticker, page_ord ORDER BY o_orderkey) - 1 AS INT) AS row_ord,
         substr(CASE WHEN report_date = '' THEN filing_date ELSE report_date END, 1, 4) AS year, form,
         cik || '-' || substr(filing_date, 3, 2) || '-' || printf('%06d', o_orderkey) AS accession_number,
         primary_document, filing_date, report_date
  FROM raw)"""

ANNUAL = f"""
annual AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, page_ord, row_ord) AS INT) AS rank
  FROM filings WHERE form IN {_list(SELECTION.annual_forms)} AND year IN {_list(SELECTION.years())}
  QUALIFY rank <= {SELECTION.per_company})"""

FALLBACK = f"""
newest AS (
  SELECT *, CAST(list_position([{', '.join(_q(f) for f in SELECTION.fallback_forms)}], form) AS INT) AS form_ord
  FROM filings WHERE form IN {_list(SELECTION.fallback_forms)}
  QUALIFY row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, page_ord, row_ord) = 1)"""

SELECTED = f"""{FILINGS}, {ANNUAL}, {FALLBACK},
selected AS (
  SELECT * FROM annual
  UNION ALL BY NAME
  SELECT * EXCLUDE (form_ord),
         CAST(row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, form_ord) AS INT) AS rank
  FROM newest WHERE ticker NOT IN (SELECT ticker FROM annual)),
placed AS (
  SELECT *, regexp_extract(primary_document, '^(?:.*/)?[^/]+?(\\.[^./]+)$', 1) AS suffix,
         'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/'
           || replace(accession_number, '-', '') || '/' || primary_document AS source_url
  FROM selected),
manifest AS (
  SELECT ticker, rank, cik, form, filing_date, report_date, accession_number, primary_document, source_url,
         year || '/' || lower(ticker) || '_' || lower(form) || '_' || filing_date || '_' || accession_number
           || CASE WHEN suffix = '' THEN '.html' ELSE suffix END AS local_path
  FROM placed)"""


def _filing_oracles() -> dict[str, str]:
    return {
        "filings_zip_extract": f"WITH {FILINGS} SELECT * FROM filings",
        "filings_from_page_files": f"""WITH {FILINGS},
named AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY cik ORDER BY page_ord) - 1 AS INT) AS n FROM filings),
shared AS (SELECT DISTINCT ticker, cik FROM filings UNION ALL
           SELECT 'S' || s_suppkey, printf('%010d', s_suppkey) FROM supplier)
SELECT shared.ticker, named.cik, n AS page_ord, row_ord, year, form, accession_number, filing_date, report_date
FROM named JOIN shared ON shared.cik = named.cik""",
        "filings_year_derivation": f"WITH {FILINGS} SELECT year, form, count(*) AS n_filings FROM filings GROUP BY ALL",
        "filings_select_annual": f"WITH {FILINGS}, {ANNUAL} SELECT * FROM annual",
        "filings_select_fallback": f"WITH {FILINGS}, {FALLBACK} SELECT * FROM newest",
        "filings_select": f"WITH {SELECTED} SELECT * FROM selected",
        "filings_paths": f"""WITH {FILINGS},
parts AS (SELECT *, regexp_extract(primary_document, '^(?:.*/)?[^/]+?(\\.[^./]+)$', 1) AS suffix FROM filings)
SELECT accession_number AS "accessionNumber", suffix,
       'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/'
         || replace(accession_number, '-', '') || '/' || primary_document AS source_url,
       year || '/' || lower(ticker) || '_' || lower(form) || '_' || filing_date || '_' || accession_number
         || CASE WHEN suffix = '' THEN '.html' ELSE suffix END AS local_path
FROM parts""",
        "filings_manifest": f"WITH {SELECTED} SELECT * FROM manifest",
        "filings_manifest_header": f"""WITH {SELECTED}
SELECT 'SEC EDGAR' AS source, {_q(','.join(SELECTION.annual_forms))} AS annual_forms,
       {_q(','.join(SELECTION.fallback_forms))} AS fallback_forms, count(*) AS downloaded_count FROM manifest""",
        "filings_downloaded_counts": f"""WITH {SELECTED}
SELECT split_part(local_path, '/', 1) AS year, count(*) AS downloaded_count FROM manifest GROUP BY ALL""",
    }


# ---- parsing --------------------------------------------------------------------


def _rules(rules, text: str) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return text


# What the elements of the given pages mean: no lists, tables or links outside navigation.
WITHOUT = [(rf"(?is)<{name}\b.*?</{name}\s*>", "") for name in ("script", "style", "head", "nav")]
ELEMENTS = [
    (r"(?s)<!--.*?-->", ""),
    *WITHOUT,
    (r"[ \t\r\n\f]+", " "),
    *[(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</?(?:h[1-6]|p|div|article|footer|body|html)\b[^>]*>", "\n\n"),
    (r"<[^>]*>", ""),
]
SPACING = [(r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n\n\n+", "\n\n"), (r"^[ \n]+", ""), (r"[ \n]+$", "")]
# The named references that the given pages may hold.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "middot": "·", "reg": "®", "mdash": "—", "ndash": "–"}
PIECE = r"&[A-Za-z]+;|&#[0-9]{1,7};|[^&]+|&"


def _unescape(text: str) -> str:
    names = " ".join(f"WHEN '&{k};' THEN {_q(v)}" for k, v in REFERENCES.items())
    return (
        f"CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(regexp_extract_all({text}, {_q(PIECE)}), lambda p: CASE "
        "WHEN regexp_matches(p, '^&#[0-9]+;$') THEN chr(CAST(regexp_extract(p, '([0-9]+)', 1) AS INT)) "
        f"ELSE CASE p {names} ELSE p END END), '') ELSE {text} END"
    )


MARKDOWN = f"""
stripped AS (SELECT page_id, url, {_rules(ELEMENTS, 'html')} AS t FROM pages),
decoded AS (SELECT page_id, url, {_unescape('t')} AS t FROM stripped),
md AS (SELECT page_id, url, {_rules(SPACING, 't')} AS markdown FROM decoded)"""

HEAD = r"^(#{1,6}) +([^\n\f]*)"
SECTIONS = MARKDOWN + rf""",
cuts AS (
  SELECT page_id, contains(markdown, chr(12)) AS paged, list_filter(string_split(
    replace(regexp_replace(markdown, '(?m)^(#{{1,6}} )', chr(1) || '\1', 'g'), chr(12), chr(1) || chr(12)), chr(1)),
    lambda p: p <> '') AS parts FROM md),
cut AS (
  SELECT page_id, paged, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS section_index FROM cuts),
heads AS (
  SELECT *, CASE WHEN starts_with(text, chr(12)) THEN 1 ELSE 0 END AS broke,
         CASE WHEN starts_with(text, chr(12)) THEN substr(text, 2) ELSE text END AS body FROM cut),
named AS (
  SELECT *, regexp_matches(body, {_q(HEAD)}) AS headed FROM heads),
sections AS (
  SELECT page_id, CAST(section_index AS INT) AS section_index,
         CAST(coalesce(last_value(CASE WHEN headed THEN length(regexp_extract(body, {_q(HEAD)}, 1)) END IGNORE NULLS) OVER w, 0) AS INT) AS level,
         last_value(CASE WHEN headed THEN trim(regexp_extract(body, {_q(HEAD)}, 2)) END IGNORE NULLS) OVER w AS section,
         CAST(CASE WHEN paged THEN 1 + CAST(sum(broke) OVER w AS INT) END AS VARCHAR) AS page, text,
         CAST(coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY section_index
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_offset
  FROM named WINDOW w AS (PARTITION BY page_id ORDER BY section_index))"""


def _chunks(source: str, keys: str, text: str = "text") -> str:
    """CTEs `w` and `c`: windows of 200 words every 150, for `source(keys, text)`."""
    return rf"""
words AS (
  SELECT {keys}, {text} AS full_text, regexp_extract_all({text}, '{WORD}') AS words,
         length(regexp_extract({text}, '^[ \t\n\f\r]*')) AS lead FROM {source}),
spans AS (
  SELECT *, unnest(generate_series(0, CASE WHEN len(words) = 0 THEN -1 WHEN len(words) <= 200 THEN 0
       ELSE CAST(ceil((len(words) - 200) / 150.0) AS INT) END)) AS i FROM words),
c AS (
  SELECT {keys}, i, regexp_replace(array_to_string(words[150 * i + 1 : 150 * i + 200], ''), '[ \t\n\f\r]+$', '') AS text,
         len(words[150 * i + 1 : 150 * i + 200]) AS token_count,
         lead + length(array_to_string(words[1 : 150 * i], '')) AS start_offset
  FROM spans)"""


DOC_CHUNKS = _chunks("documents", "doc_id") + """,
chunks AS (
  SELECT doc_id, doc_id || '-' || i AS chunk_id, CAST(i AS INT) AS chunk_index, text,
         CAST(token_count AS INT) AS token_count, CAST(start_offset AS INT) AS start_offset,
         CAST(start_offset + length(text) AS INT) AS end_offset FROM c)"""


def _parsing_oracles() -> dict[str, str]:
    title = r"(?is)<title[^>]*>(.*?)</title\s*>"
    raw = f"regexp_extract(html, {_q(title)}, 1)"
    return {
        "html_to_markdown": f"WITH {MARKDOWN} SELECT * FROM md",
        "html_title": f"""WITH t AS (SELECT page_id, {raw} AS t FROM pages), u AS (SELECT page_id, {_unescape('t')} AS t FROM t)
SELECT page_id, nullif(trim(regexp_replace(t, '{BLANK}', ' ', 'g')), '') AS title FROM u""",
        "html_sections": f"WITH {SECTIONS} SELECT * FROM sections",
        "page_chunks": f"""WITH {SECTIONS}, {_chunks('sections', 'page_id, section_index, section, page, start_offset AS base')
        .replace('SELECT page_id, section_index, section, page, start_offset AS base, i', 'SELECT page_id, section_index, section, page, base, i')},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY section_index, i) - 1 AS INT) AS chunk_index FROM c)
SELECT page_id, page_id || '-' || chunk_index AS chunk_id, chunk_index, section, page, text,
       CAST(token_count AS INT) AS token_count, CAST(base + start_offset AS INT) AS start_offset,
       CAST(base + start_offset + length(text) AS INT) AS end_offset FROM numbered""",
        "chunk_documents_200_150": f"WITH {DOC_CHUNKS} SELECT * FROM chunks",
        "incremental_ingest_availablenow": f"WITH {DOC_CHUNKS} SELECT * FROM chunks",
        "passage_changes_by_source": CHANGES,
        "incremental_corpus_update": f"""WITH said AS (
  SELECT doc_id, lang, CASE WHEN quality IS NULL THEN text ELSE coalesce(text, '') || ' quality ' || quality END AS text,
         CASE WHEN quality IS NULL THEN 1 ELSE 2 END AS generation
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
{_chunks("said", "doc_id, lang, generation")}
SELECT doc_id, doc_id || '-' || i AS chunk_id, lang, CAST(token_count AS INT) AS token_count, CAST(start_offset AS INT) AS start_offset,
       CAST(start_offset + length(text) AS INT) AS end_offset, generation, md5(text) AS text_md5 FROM c""",
        "chunk_token_counts": f"""WITH {DOC_CHUNKS}
SELECT doc_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM chunks GROUP BY ALL""",
        "chunk_with_document_metadata": f"""WITH {DOC_CHUNKS}
SELECT chunk_id, doc_id, lang, source, CAST(length(chunks.text) AS INT) AS n_chars FROM chunks JOIN documents USING (doc_id)""",
        "postings_build": f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS toks FROM documents),
e AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t)
SELECT term, doc_id, CAST(count(*) AS INT) AS tf, CAST(dl AS INT) AS dl FROM e GROUP BY term, doc_id, dl""",
        "corpus_term_statistics": f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS toks FROM documents),
e AS (SELECT len(toks) AS dl, unnest(list_distinct(toks)) AS term FROM t)
SELECT term, count(*) AS df, CAST(sum(dl) AS BIGINT) AS total_dl FROM e GROUP BY term
UNION ALL SELECT '', count(*), CAST(sum(len(toks)) AS BIGINT) FROM t""",
    }


# ---- comparison -----------------------------------------------------------------

#: The alignment as a recursion over the candidates of each pair of versions: `best` and
#: `prev` grow by one entry a step, then the chain is followed back from its end.
CHANGES = rf"""
WITH RECURSIVE
  d AS MATERIALIZED (
    SELECT source, doc_id, string_split(text, chr(10)) AS ls,
           lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS following FROM documents),
  lines AS MATERIALIZED (
    SELECT source, doc_id, idx - 1 AS i, ws FROM (
      SELECT source, doc_id, unnest(range(1, len(ls) + 1)) AS idx,
             list_filter(string_split_regex(lower(ls[idx]), {_q(UNICODE)}), lambda w: w <> '') AS ws FROM d)
    WHERE len(ws) > 0),
  sh AS (
    SELECT doc_id, i, ws, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 1), lambda j: array_to_string(ws[j:j + 2], ' ')) END) AS s,
           unnest(range(greatest(len(ws) - 2, 1))) AS pos FROM lines),
  nth AS MATERIALIZED (
    SELECT doc_id, i, ws, s, row_number() OVER (PARTITION BY doc_id, s ORDER BY i, pos) AS k FROM sh),
  links AS (SELECT source, doc_id AS x, following AS y FROM d WHERE following IS NOT NULL),
  cand AS MATERIALIZED (
    SELECT x, y, a.i AS o, b.i AS n, 2000000 * count(*) // (greatest(len(a.ws) - 2, 1) + greatest(len(b.ws) - 2, 1)) AS w, a.ws = b.ws AS same
    FROM links JOIN nth a ON a.doc_id = x JOIN nth b ON b.doc_id = y AND a.s = b.s AND a.k = b.k
    GROUP BY x, y, a.i, b.i, a.ws, b.ws HAVING w >= 300000),
  g AS MATERIALIZED (SELECT x, list({{'o': o, 'n': n, 'w': w, 'same': same}} ORDER BY o, n) AS c FROM cand GROUP BY x),
  steps AS (
    SELECT x, 0 AS pos, []::BIGINT[] AS best, []::BIGINT[] AS prev FROM g
    UNION ALL
    SELECT x, pos + 1, list_append(best, c[pos + 1].w + top), list_append(prev, CASE WHEN top > 0 THEN
             list_min(list_filter(fits, lambda j: best[j] = top)) ELSE 0 END)
    FROM (SELECT *, coalesce(list_max(list_transform(fits, lambda j: best[j])), 0) AS top FROM (
      SELECT x, pos, best, prev, c,
             list_filter(range(1, pos + 1), lambda j: c[j].o < c[pos + 1].o AND c[j].n < c[pos + 1].n) AS fits
      FROM steps JOIN g USING (x) WHERE pos < len(c)))),
  done AS MATERIALIZED (SELECT x, best, prev FROM steps JOIN g USING (x) WHERE pos = len(c)),
  back AS (
    SELECT x, list_position(best, list_max(best))::BIGINT AS pos, prev FROM done
    UNION ALL SELECT x, prev[pos], prev FROM back WHERE prev[pos] > 0),
  pairs AS MATERIALIZED (SELECT x, c[pos].o AS o, c[pos].n AS n, c[pos].w AS w, c[pos].same AS same FROM back JOIN g USING (x))
SELECT source, x AS old_doc_id, y AS new_doc_id, CAST(o AS INT) AS old_index, CAST(n AS INT) AS new_index,
       CASE WHEN same THEN 'kept' ELSE 'changed' END AS change, w / 1000000.0::DOUBLE AS similarity
FROM pairs JOIN links USING (x)
UNION ALL
SELECT links.source, x, y, CAST(i AS INT), NULL, 'removed', NULL FROM links JOIN lines ON lines.doc_id = x
WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.x = links.x AND o = i)
UNION ALL
SELECT links.source, x, y, NULL, CAST(i AS INT), 'added', NULL FROM links JOIN lines ON lines.doc_id = y
WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.x = links.x AND n = i)"""


# ---- retrieval ------------------------------------------------------------------


def _bm25(
    name: str, docs: str, queries: str, depth: int, doc_id: str = "doc_id", breaks: str = ASCII,
    facet: str | None = None, where: str = "true",
) -> str:
    """CTEs ending in `name(query_id, [facet], doc_id, score, rank)`."""
    f = f"{facet}, " if facet else ""
    return f"""
{name}_t AS (SELECT {f}{doc_id}, ({where}) AS kept, {_tokens('text', breaks)} AS toks FROM {docs}),
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS mean_dl FROM {name}_t),
{name}_e AS (SELECT {f}{doc_id}, kept, len(toks) AS dl, unnest(toks) AS term FROM {name}_t),
{name}_tf AS (SELECT {f}{doc_id}, kept, dl, term, count(*) AS tf FROM {name}_e GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT query_id, unnest(list_distinct({_tokens('text', breaks)})) AS term FROM {queries}),
{name}_s AS (
  SELECT query_id, {f}{doc_id}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl))), 6) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term) CROSS JOIN {name}_n
  WHERE kept GROUP BY query_id, {f}{doc_id}),
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id{', ' + facet if facet else ''} ORDER BY score DESC, {doc_id}) AS INT) AS rank
  FROM {name}_s QUALIFY rank <= {depth})"""


BENCH = "bench AS (SELECT item_id AS query_id, text FROM benchmark)"


def _cosine(depth: int, where: str = "true") -> str:
    return f"""
sem_q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings
          WHERE vec_id IN (SELECT item_id FROM benchmark)),
sem AS (
  SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY
           round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS INT) AS rank
  FROM sem_q CROSS JOIN embeddings WHERE {where} QUALIFY rank <= {depth})"""


def _fused(k: int, where: str = "true", vector_where: str = "true") -> str:
    return f"""{BENCH}, {_bm25('lex', 'documents', 'bench', 50, where=where)}, {_cosine(50, vector_where)},
fused AS (
  SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.doc_id, s.doc_id) AS doc_id,
         round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS rrf_score,
         coalesce(l.rank, 0) AS lexical_rank, coalesce(s.rank, 0) AS semantic_rank
  FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.doc_id = s.doc_id),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS INT) AS rank
  FROM fused QUALIFY rank <= {k})"""


EXCERPT = f"trim(substr(regexp_replace(text, '{BLANK}', ' ', 'g'), 1, 200))"


KNOWN = "vec_id IN (SELECT doc_id FROM documents)"


def _retrieval_oracles() -> dict[str, str]:
    lexical = f"WITH {BENCH}, {_bm25('lex', 'documents', 'bench', 50)} SELECT * FROM lex"
    chunk_hits = f"{BENCH}, {DOC_CHUNKS}, " + "{hits}"
    german = "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"
    return {
        "lexical_search_topk": lexical,
        "lexical_search_unicode": f"WITH {BENCH}, {_bm25('lex', 'documents', 'bench', 50, breaks=UNICODE)} SELECT * FROM lex",
        "lexical_search_chunks": "WITH " + chunk_hits.format(hits=_bm25("lex", "chunks", "bench", 10, "chunk_id"))
        + " SELECT * FROM lex",
        "read_chunk": "WITH " + chunk_hits.format(hits=_bm25("lex", "chunks", "bench", 1, "chunk_id"))
        + " SELECT query_id, chunk_id, chunk_index, text, token_count FROM lex JOIN chunks USING (chunk_id)",
        "surrounding_chunks_of_hits": "WITH " + chunk_hits.format(hits=_bm25("lex", "chunks", "bench", 3, "chunk_id"))
        + """ SELECT query_id, rank, h.doc_id, h.chunk_index AS hit_index,
          CAST(n.chunk_index - h.chunk_index AS INT) AS "offset", n.chunk_id, n.text
          FROM lex JOIN chunks h USING (chunk_id) JOIN chunks n ON n.doc_id = h.doc_id
          AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1""",
        "semantic_search_topk": f"WITH {_cosine(50)} SELECT * FROM sem",
        "rrf_fusion": f"WITH {_fused(100)} SELECT * FROM hits",
        "hybrid_search_topk": f"WITH {_fused(10, vector_where=KNOWN)} SELECT * FROM hits",
        "search_filings_tool": f"""WITH {_fused(10, vector_where=KNOWN)} SELECT hits.*, lang, source, n_chars, {EXCERPT} AS excerpt
FROM hits LEFT JOIN documents USING (doc_id)""",
        "search_filtered_by_lang": f"WITH {_fused(10, 'lang = ' + _q('en'), german.replace('doc_id IN', 'vec_id IN'))} SELECT * FROM hits",
        "search_balanced_per_source": f"WITH {BENCH}, {_bm25('lex', 'documents', 'bench', 2, facet='source')} SELECT * FROM lex",
        "search_balanced_per_source_and_lang": f"""WITH {BENCH},
faceted AS (SELECT doc_id, text, source, lang, coalesce(source, '') || chr(31) || coalesce(lang, '') AS facet FROM documents),
{_bm25('lex', 'faceted', 'bench', 4, facet='facet')},
vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
vs AS (SELECT query_id, vec_id AS doc_id, facet, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS score
       FROM vq CROSS JOIN embeddings JOIN faceted ON doc_id = vec_id),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 4),
f AS (
  SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS rrf_score,
         CAST(coalesce(l.rank, 0) AS INT) AS lexical_rank, CAST(coalesce(s.rank, 0) AS INT) AS semantic_rank
  FROM lex l FULL JOIN sem s USING (query_id, doc_id)),
t AS (
  SELECT f.*, source, lang, CAST(row_number() OVER (PARTITION BY query_id, source, lang ORDER BY rrf_score DESC, doc_id) AS INT) AS turn
  FROM f JOIN documents USING (doc_id))
SELECT query_id, doc_id, rrf_score, lexical_rank, semantic_rank, source, lang, turn,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, rrf_score DESC, doc_id) AS INT) AS rank
FROM t QUALIFY rank <= 12""",
        "search_by_nested_metadata": f"""WITH {BENCH},
extended AS (SELECT doc_id, text, lang, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM documents LEFT JOIN events ON event_id = doc_id),
{_bm25('lex', 'extended', 'bench', 10, where="coalesce(lang IN ('en', 'de') AND (k < 20 OR k >= 70), false)")}
SELECT * FROM lex""",
        "search_insufficient_evidence": f"""WITH {BENCH}, {_bm25('lex', 'documents', 'bench', 50)}, {_cosine(50)},
l AS (SELECT query_id, count(*) AS n_lexical FROM lex WHERE score >= {EVIDENCE_SCORE} GROUP BY ALL),
s AS (SELECT query_id, max(score) AS best_cosine FROM sem WHERE doc_id <> query_id GROUP BY ALL)
SELECT query_id, coalesce(n_lexical, 0) AS n_lexical, best_cosine,
       CASE WHEN coalesce(n_lexical, 0) = 0 AND coalesce(best_cosine, -1) < {EVIDENCE_COSINE} THEN 'insufficient' ELSE 'ok' END AS status
FROM bench LEFT JOIN l USING (query_id) LEFT JOIN s USING (query_id)""",
    }


# ---- chats and grounding --------------------------------------------------------

TURNS = """
pairs AS (
  SELECT u.conv_id AS thread_id, u.turn AS ordinal, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
turns AS (
  SELECT thread_id || '-' || ordinal AS turn_id, *, length(answer) < 60 AS insufficient FROM pairs),
questions AS (SELECT turn_id AS query_id, question AS text FROM turns),
answers AS (SELECT turn_id AS query_id, answer AS text FROM turns)"""

CITED = f"""{TURNS}, {_bm25('ret', 'documents', 'questions', 10)}, {_bm25('ans', 'documents', 'answers', 20)},
cited AS (
  SELECT a.query_id AS turn_id, a.doc_id FROM ans a LEFT JOIN ret r ON r.query_id = a.query_id AND r.doc_id = a.doc_id
  WHERE r.doc_id IS NOT NULL OR (a.rank = 1 AND a.score >= {CITATION_FLOOR}))"""

STATUS = f"""{CITED},
checked AS (
  SELECT c.turn_id, c.doc_id, r.doc_id IS NOT NULL AS was_retrieved, l.doc_id IS NOT NULL AS is_complete
  FROM cited c LEFT JOIN ret r ON r.query_id = c.turn_id AND r.doc_id = c.doc_id
  LEFT JOIN labels l ON l.doc_id = c.doc_id),
counted AS (
  SELECT turn_id, count(*) AS n_citations, count(*) FILTER (NOT was_retrieved) AS n_unretrieved,
         count(*) FILTER (was_retrieved AND NOT is_complete) AS n_incomplete FROM checked GROUP BY turn_id),
judged AS (
  SELECT turn_id, thread_id, ordinal, question, answer AS said, coalesce(n_citations, 0) AS n_citations,
         coalesce(n_unretrieved, 0) AS n_unretrieved, coalesce(n_incomplete, 0) AS n_incomplete,
         CASE WHEN n_unretrieved > 0 OR n_incomplete > 0 THEN 'grounding_failed'
              WHEN n_citations > 0 THEN 'ok' WHEN insufficient THEN 'insufficient' ELSE 'grounding_failed' END AS status
  FROM turns LEFT JOIN counted USING (turn_id))"""

LOG = """
log AS (
  SELECT conv_id AS thread_id, turn AS ordinal, conv_id || '-' || turn AS message_id, role, text, user_id,
         ts AS created_at, event_type
  FROM conversations LEFT JOIN events ON event_id = conv_id * 8 + turn)"""

THREADS = f"""{LOG},
threads AS (
  SELECT thread_id, arg_min(user_id, ordinal) AS user_id,
         trim(substr(regexp_replace(arg_min(text, ordinal) FILTER (role = 'user'), '{BLANK}', ' ', 'g'), 1, 80)) AS title,
         min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_messages
  FROM log GROUP BY thread_id)"""

PARTS = rf"""{LOG},
words AS (SELECT message_id, event_type, role,
  list_filter(regexp_extract_all(text, '[^ \t\n\f\r]*[ \t\n\f\r]*'), lambda w: w <> '') AS words FROM log),
parts AS (
  SELECT message_id, unnest(words) AS payload, generate_subscripts(words, 1) - 1 AS seq, 'text-delta' AS part_type FROM words
  UNION ALL BY NAME SELECT message_id, len(words) AS seq, 'source' AS part_type, role AS payload FROM words
  UNION ALL BY NAME SELECT message_id, len(words) + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'finish' END AS part_type,
    CASE WHEN event_type = 'error' THEN 'retrieval_failed' END AS payload FROM words)"""


CALLERS = "(SELECT user_id FROM events WHERE event_type = 'click')"


def _chat_oracles() -> dict[str, str]:
    passed = f"{STATUS}, owners AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events)"
    owner = "LEFT JOIN owners ON event_id = thread_id * 8 + ordinal WHERE status <> 'grounding_failed'"
    return {
        "citations_unretrieved": f"""WITH {CITED} SELECT turn_id, doc_id FROM cited c
WHERE NOT EXISTS (SELECT 1 FROM ret r WHERE r.query_id = c.turn_id AND r.doc_id = c.doc_id)""",
        "citations_missing": f"""WITH {CITED} SELECT turn_id, insufficient FROM turns
WHERE turn_id NOT IN (SELECT turn_id FROM cited)""",
        "grounding_status": f"""WITH {STATUS} SELECT turn_id, n_citations, n_unretrieved, n_incomplete, status,
CASE WHEN status <> 'grounding_failed' THEN said END AS answer FROM judged""",
        "citations_for_display": f"""WITH {STATUS}
SELECT turn_id, doc_id, source AS company, lang AS filing_type, '2024-01-01' AS filing_date,
       'quality ' || quality AS section, {EXCERPT} AS excerpt
FROM judged JOIN checked USING (turn_id) JOIN documents USING (doc_id) JOIN labels USING (doc_id)
WHERE status = 'ok'""",
        "turn_persistence": f"""WITH {passed}
SELECT turn_id || '-user' AS message_id, thread_id, user_id, CAST(ordinal AS INT) AS ordinal, 'user' AS role,
       CAST(length(question) AS INT) AS n_chars FROM judged {owner}
UNION ALL SELECT turn_id || '-assistant', thread_id, user_id, CAST(ordinal + 1 AS INT), 'assistant',
       CAST(length(said) AS INT) FROM judged {owner}""",
        "turn_citations": f"""WITH {passed}
SELECT DISTINCT c.turn_id || '-' || c.doc_id AS citation_id, c.turn_id || '-assistant' AS message_id,
       CAST(c.doc_id AS VARCHAR) AS chunk_id, user_id
FROM cited c JOIN judged USING (turn_id) {owner}""",
        "turn_usage": f"""WITH {passed} SELECT thread_id, user_id, turn_id,
CAST(len({_tokens('question')}) AS BIGINT) AS input_tokens, CAST(len({_tokens('said')}) AS BIGINT) AS output_tokens
FROM judged {owner}""",
        "thread_list": f"WITH {THREADS} SELECT * FROM threads WHERE user_id IN {CALLERS}",
        "thread_history": f"""WITH {LOG} SELECT thread_id, ordinal, user_id, role, text, created_at FROM log
WHERE user_id IN {CALLERS}""",
        "document_access": """WITH asked AS (SELECT event_id, 7 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id FROM events)
SELECT event_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 'ok' ELSE 'not_found' END AS access FROM asked""",
        "thread_last_turn": """SELECT conv_id AS thread_id, max(turn) AS ordinal, arg_max(role, turn) AS role,
arg_max(text, turn) AS text FROM conversations GROUP BY conv_id""",
        "turn_pairs": f"WITH {TURNS} SELECT thread_id, ordinal, question, answer FROM pairs",
        "thread_access": f"""WITH {THREADS},
asked AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS thread_id FROM events)
SELECT a.event_id, a.user_id, a.thread_id, CASE WHEN t.thread_id IS NULL THEN 'not_found'
  WHEN t.user_id = a.user_id THEN 'ok' ELSE 'forbidden' END AS access
FROM asked a LEFT JOIN threads t ON t.thread_id = a.thread_id""",
        "ui_message_conversion": f"WITH {LOG} SELECT message_id, role, text, 0 AS n_sources FROM log",
        "message_parts": f"WITH {PARTS} SELECT message_id, CAST(seq AS INT) AS seq, part_type, payload FROM parts",
        "message_assembly": f"""WITH {LOG}
SELECT message_id, text, CAST(len(list_filter(regexp_extract_all(text, '[^ \\t\\n\\f\\r]*[ \\t\\n\\f\\r]*'), lambda w: w <> ''))
  AS BIGINT) AS n_deltas, CAST(1 AS BIGINT) AS n_sources, CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status,
  CASE WHEN event_type = 'error' THEN 'retrieval_failed' END AS error FROM log""",
        "streamed_message_commit": f"""WITH {LOG}
SELECT message_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status,
  CASE WHEN event_type = 'error' THEN NULL ELSE text END AS text FROM log""",
    }


def oracles() -> dict[str, str]:
    return {**_filing_oracles(), **_parsing_oracles(), **_retrieval_oracles(), **_chat_oracles()}
