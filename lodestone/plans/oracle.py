"""The same results in SQL for another engine, which checks the queries."""

from __future__ import annotations

from lodestone.operators.extract import CATEGORIES, CELL_CODE, CODE_HEADER, ERROR_CODE, ERROR_TABLE, MODEL_CODE
from lodestone.operators.layout import BULLETS, CHATTER, OCR_RULES, TABLE_WORDS
from lodestone.operators.parse import CONTINUATION, HEADING, PAGE_MARKER, TITLE_SUFFIX
from lodestone.operators.understand import ROMAN_URDU


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lines(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


CHUNKS = "chunks AS (SELECT chunk_id, min(text) AS text, arg_min(metadata, text) AS metadata FROM phase1_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({x}, '[*_`#]', ' ', 'g')), '[a-z0-9]+')"


_LABEL = "CASE WHEN {c} <> '' AND {c} <> 'general' THEN replace({c}, '_', ' ') END"
EMBEDDING = f"""concat_ws(chr(10), 'Section: ' || nullif(metadata.title, ''), 'Product: ' || {_LABEL.format(c="metadata.product_category")},
 'Error Codes: ' || nullif(coalesce(array_to_string(metadata.error_codes, ', '), ''), ''),
 'Models: ' || nullif(coalesce(array_to_string(metadata.model_names[1:10], ', '), ''), ''), coalesce(text, ''))"""
RERANK = f"concat_ws(chr(10), nullif(metadata.title, ''), {_LABEL.format(c='metadata.product_category')}, nullif(text, ''))"

LEXICAL = f"""{CHUNKS}, texts AS (SELECT chunk_id, {EMBEDDING} AS text FROM chunks),
 toks AS (SELECT chunk_id, unnest({_tokens("text")}) AS term FROM texts),
 post AS (SELECT term, chunk_id, count(*) AS tf FROM toks GROUP BY ALL),
 dl AS (SELECT chunk_id, len({_tokens("text")}) AS dl FROM texts), n AS (SELECT count(*) AS n FROM dl),
 raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS ri FROM post GROUP BY term),
 terms AS (SELECT term, df, CASE WHEN ri < 0 THEN 0.25 * (SELECT avg(ri) FROM raw) ELSE ri END AS idf FROM raw)"""

EXACT = rf"""{CHUNKS}, exact_raw AS (SELECT 'error_codes' AS kind, unnest(metadata.error_codes) AS k, chunk_id FROM chunks
 UNION ALL SELECT 'model_names', unnest(metadata.model_names), chunk_id FROM chunks),
 exact AS (SELECT DISTINCT kind, upper({_strip("k")}) AS key, chunk_id FROM exact_raw WHERE upper({_strip("k")}) <> '')"""
ASKED = rf"""asked_raw AS (SELECT qid, 'error_codes' AS kind, unnest(regexp_extract_all(upper(text), {_q(ERROR_CODE)})) AS k FROM questions
 UNION ALL SELECT qid, 'model_names', unnest(regexp_extract_all(upper(text), {_q(MODEL_CODE)})) FROM questions),
 asked AS (SELECT DISTINCT qid, kind, upper(regexp_replace(k, '\s+', '', 'g')) AS key FROM asked_raw)"""


def _exact(mode: str) -> str:
    key = r"regexp_replace(e.key, '\s+', '', 'g')" if mode == "normalized" else "e.key"
    return f"""WITH {EXACT}, {ASKED}, hits AS (SELECT DISTINCT a.qid, e.chunk_id FROM asked a JOIN exact e ON a.kind = e.kind AND a.key = {key})
 SELECT qid, chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY chunk_id)::INT AS rank FROM hits"""


VECTORS = """v AS (SELECT vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
 pairs AS (SELECT q.vec_id AS qid, v.vec_id, q.label AS ql, v.label AS vl, greatest(0.0, 1 - (1 - list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] / q.n) * (p[2] / v.n)))) / 2) AS score
 FROM v q, v WHERE q.vec_id % 50 = 0)"""

LISTS = """hits AS (SELECT qid, lower(trim(source)) AS source, chunk_id, max(score) AS score FROM retrieved_chunks
 WHERE lower(trim(source)) IN ('exact', 'vector', 'bm25') AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
 lists AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, chunk_id) AS rank,
 CASE source WHEN 'exact' THEN 0 WHEN 'vector' THEN 1 ELSE 2 END AS place FROM hits),
 fused_all AS (SELECT qid, chunk_id, coalesce(sum(CASE WHEN place = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(sum(CASE WHEN place = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0)
 + coalesce(sum(CASE WHEN place = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score, min(place * 1000000000 + rank) AS first FROM lists GROUP BY ALL),
 fused AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) AS fused_rank FROM fused_all QUALIFY fused_rank <= 10)"""
FINAL = f"""{CHUNKS}, {LISTS}, found AS (SELECT f.qid, f.chunk_id, f.fused_rank, c.text, c.metadata, q.text AS question FROM fused f JOIN chunks c USING (chunk_id) JOIN questions q USING (qid)),
 tok AS (SELECT *, list_distinct({_tokens("question")}) AS qt, list_distinct({_tokens(RERANK)}) AS ct FROM found),
 final AS (SELECT *, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt)::DOUBLE ELSE 0 END AS score,
 row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt)::DOUBLE ELSE 0 END DESC, fused_rank) AS rank FROM tok QUALIFY rank <= 5)"""

_TEXT = _lines("text")
MANUALS = f"""{CHUNKS}, base AS (SELECT chunk_id AS doc_id, coalesce(metadata.page_start, 1) AS p, coalesce(metadata.title, 'Untitled') AS t,
 coalesce(metadata.section, 'features') AS s, {_TEXT} AS x FROM chunks),
 manuals AS (SELECT doc_id, array_to_string(['## PAGE ' || p, '# ' || t, 'PAGE' || chr(10) || (p + 1), '# ' || t || ' (Cont..)', x, 'PAGE ' || (p + 2), '## ' || s, 'Cont......', x, '## ' || s,
 'See the table of error codes and check whether the supply is on: yes or no.'], chr(10)) AS raw FROM base WHERE x IS NOT NULL)"""
_MARK = _q("(?mi)" + PAGE_MARKER)
PAGES = f"""{MANUALS}, cut AS (SELECT doc_id, regexp_extract_all(raw, {_MARK}, 1) AS nums, regexp_split_to_array(raw, {_MARK}) AS bodies FROM manuals),
 pages AS (SELECT doc_id, (i - 1)::INT AS page_ord, try_cast(nums[i] AS INT) AS page_num, {_strip("bodies[i + 1]")} AS text
 FROM (SELECT doc_id, nums, bodies, unnest(range(1, len(nums) + 1)) AS i FROM cut))"""
DIVIDER = rf"""(NOT len(list_filter(string_split(text, chr(10)), lambda l: starts_with({_strip("l")}, '|'))) > 0 AND
 len(list_filter(regexp_split_to_array(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_strip("l")}),
 lambda l: l <> '' AND NOT regexp_matches(l, '^#{{1,6}}\s+')), ' '), '\s+'), lambda w: w <> '')) < 15)"""
_BARE = f"regexp_replace(text, {_q(TITLE_SUFFIX)}, '', 'g')"
_CLEAN = _strip(f"regexp_replace({_BARE}, {_q(CONTINUATION)}, '', 'g')")
_STATE = "last_value(CASE WHEN lvl = {n} THEN {{'h': heading}} WHEN lvl > 0 AND lvl < {n} THEN {{'h': NULL::VARCHAR}} END IGNORE NULLS) OVER w"
SECTIONS = rf"""{PAGES}, clean AS (SELECT doc_id, page_ord, page_num, {_CLEAN} AS text, regexp_matches({_BARE}, {_q(CONTINUATION)}) AS has_cont FROM pages WHERE NOT {DIVIDER}),
 split AS (SELECT doc_id, page_ord, page_num, string_split(text, chr(10)) AS ls FROM clean),
 lines AS (SELECT doc_id, page_ord, page_num, i AS line_no, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM split)),
 lev AS (SELECT *, length(regexp_extract(line, {_q(HEADING)}, 1)) AS lvl, {_strip(f"regexp_extract(line, {_q(HEADING)}, 2)")} AS heading FROM lines),
 st AS (SELECT doc_id, page_ord, page_num, line_no, line, lvl, sum((lvl > 0)::INT) OVER w AS section, {", ".join(_STATE.format(n=n) + f" AS h{n}" for n in range(1, 7))}
 FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY page_ord, line_no ROWS UNBOUNDED PRECEDING)),
 pathed AS (SELECT *, list_filter([h1.h, h2.h, h3.h, h4.h, h5.h, h6.h], lambda x: x IS NOT NULL) AS path FROM st),
 secs AS (SELECT doc_id, section, any_value(path) AS path, {_strip("coalesce(string_agg(line, chr(10) ORDER BY page_ord, line_no) FILTER (lvl = 0), '')")} AS content,
 list_sort(list_distinct(list(page_num))) AS pages FROM pathed GROUP BY doc_id, section),
 raw_sections AS (SELECT * FROM secs WHERE content <> ''),
 marked AS (SELECT *, coalesce((lag(path) OVER w <> path)::INT, 1) AS new FROM raw_sections WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY section ROWS UNBOUNDED PRECEDING) AS island FROM marked),
 merged AS (SELECT doc_id, island AS section, any_value(path) AS path, string_agg(content, chr(10) || chr(10) ORDER BY section) AS content,
 list_sort(list_distinct(flatten(list(pages)))) AS pages FROM isl GROUP BY doc_id, island)"""


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_q(p)})"


def _flow(x: str) -> str:
    return rf"""({_has(x, "(?i)Flowchart")} OR ({_has(x, r"(?i)\bYes\b")} AND {_has(x, r"(?i)\bNo\b")} AND ({_has(x, r"(?i)\bCheck\b")} OR {_has(x, "→|↓|->")}
 OR {_has(x, r"(?i)\bReplace\b")} OR {_has(x, r"(?i)\bwhether\b")})))"""


def _type(x: str) -> str:
    table = _has(x, r"\|[\s\-:|]+\|")
    return rf"""CASE WHEN {_has(x, "(?i)warranty")} THEN 'warranty' WHEN {table} AND {_has(x, r"(?i)error\s*code|\bfault\b|failure")} THEN 'error_code_table'
 WHEN {table} THEN 'spec_table' WHEN {_has(x, r"(?i)installation|installing|\binstall\b")} THEN 'installation_sop' ELSE 'text' END"""


def _pack(x: str) -> str:
    """Greedy packing: the fold's state is done parts, the open part and its running size."""
    start = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'size': 0::BIGINT, 'p': NULL::VARCHAR}"
    item = "{'done': []::VARCHAR[], 'open': NULL::VARCHAR, 'size': 0::BIGINT, 'p': v}"
    full = "a.open IS NOT NULL AND a.size + length(b.p) > 4000"
    return f"""list_reduce(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda v: {item}), lambda a, b: {{
 'done': CASE WHEN {full} THEN list_append(a.done, a.open) ELSE a.done END,
 'open': CASE WHEN a.open IS NULL OR ({full}) THEN b.p ELSE a.open || chr(10) || chr(10) || b.p END,
 'size': (CASE WHEN {full} THEN 0 ELSE a.size END) + length(b.p) + 2, 'p': NULL::VARCHAR}}, {start})"""


ROUTED = f"""{SECTIONS}, kinded AS (SELECT *, CASE WHEN {_flow("content")} THEN 'troubleshooting_flow' ELSE {_type("content")} END AS content_type,
 len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS n_words, {_pack("content")} AS packed FROM merged),
 routed AS (SELECT *, CASE WHEN n_words < 3 THEN []::VARCHAR[] WHEN content_type IN ('troubleshooting_flow', 'spec_table', 'error_code_table', 'warranty') OR length(content) <= 4000 THEN [content]
 ELSE list_append(packed.done, packed.open) END AS parts FROM kinded)"""


def _category(text: str, title: str) -> str:
    blob = f"lower({title} || chr(10) || {text})"
    cases = " ".join("WHEN " + " OR ".join(f"contains({blob}, {_q(k)})" for k in keys) + f" THEN '{name}'" for name, keys in CATEGORIES)
    return f"CASE {cases} ELSE 'general' END"


def _section(text: str, kind: str, title: str) -> str:
    return f"""CASE {kind} WHEN 'troubleshooting_flow' THEN 'troubleshooting' WHEN 'error_code_table' THEN 'error_codes' WHEN 'warranty' THEN 'warranty'
 WHEN 'installation_sop' THEN 'installation' WHEN 'spec_table' THEN 'specifications' ELSE CASE WHEN contains(lower({title}), 'warranty') THEN 'warranty'
 WHEN contains(lower({title}), 'install') THEN 'installation' WHEN contains(lower({title}), 'error code') OR contains(lower({title}), 'troubleshoot') OR contains(lower({title}), 'fault') THEN 'troubleshooting'
 WHEN {_has(text, "(?i)troubleshoot|error code|fault")} THEN 'troubleshooting' WHEN {_has(text, "(?i)install")} THEN 'installation' WHEN {_has(text, "(?i)warranty")} THEN 'warranty' ELSE 'features' END END"""


TABLES = rf"""{CHUNKS}, tl AS (SELECT chunk_id, string_split({_TEXT}, chr(10)) AS ls FROM chunks),
 ln AS (SELECT chunk_id, i, {_strip("ls[i]")} AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM tl)),
 mk AS (SELECT *, starts_with(line, '|') AS bar, sum((NOT starts_with(line, '|'))::INT) OVER (PARTITION BY chunk_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM ln),
 tb AS (SELECT chunk_id, run, list(line ORDER BY i) AS rows_ FROM mk WHERE bar GROUP BY ALL HAVING count(*) >= 2),
 rw AS (SELECT chunk_id, run, j, list_transform(string_split(regexp_replace(rows_[j], '^\|+|\|+$', '', 'g'), '|'), lambda c: {_strip("c")}) AS cells
 FROM (SELECT *, unnest(range(1, len(rows_) + 1)) AS j FROM tb)),
 kept AS (SELECT * FROM rw WHERE len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-{{2,}}:?$'))) > 0),
 numbered AS (SELECT chunk_id, dense_rank() OVER (PARTITION BY chunk_id ORDER BY run) - 1 AS table_no, row_number() OVER (PARTITION BY chunk_id, run ORDER BY j) - 1 AS row_no, cells FROM kept),
 cell AS (SELECT chunk_id, table_no::INT AS table_no, row_no::INT AS row_no, (k - 1)::INT AS column_no, cells[k] AS cell FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS k FROM numbered)),
 heads AS (SELECT chunk_id, table_no, column_no, cell AS head FROM cell WHERE row_no = 0),
 wanted AS (SELECT chunk_id, table_no FROM cell WHERE row_no = 0 GROUP BY ALL HAVING regexp_matches(string_agg(cell, ' ' ORDER BY column_no), {_q(ERROR_TABLE)})),
 tcodes AS (SELECT DISTINCT chunk_id, code FROM (SELECT c.chunk_id, upper(replace(unnest(regexp_extract_all({_strip("regexp_replace(c.cell, '<br[ ]*/?>', ' ', 'g')")}, {_q(CELL_CODE)})), ' ', '')) AS code
 FROM cell c JOIN wanted USING (chunk_id, table_no) JOIN heads h USING (chunk_id, table_no, column_no) WHERE c.row_no > 0 AND regexp_matches(h.head, {_q(CODE_HEADER)}) AND NOT contains(lower(h.head), 'inverter'))
 WHERE code <> '' AND length(code) <= 5)"""

ITEMS = """numbered_items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS n FROM lineitem),
 items AS (SELECT l_orderkey::VARCHAR AS doc_id, n::INT AS item_ord, (l_suppkey % 4)::INT AS level,
 ['text', 'section_header', 'list_item', 'table', 'picture', 'title', 'text'][(l_partkey % 7 + 1)::INT] AS label, ceil(n / 9.0)::INT AS page,
 'part ' || l_partkey || ' by ' || coalesce(l_returnflag, '') AS content FROM numbered_items)"""
OCR = f"""{CHUNKS}, ol AS (SELECT chunk_id AS image_id, string_split({_TEXT}, chr(10)) AS ls FROM chunks),
 oc AS (SELECT image_id, i - 1 AS line_ord, ls[i] AS text, length(ls[i]) % 10 / 10.0::DOUBLE AS score FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM ol))"""


def _garbage(x: str) -> str:
    s = _strip(x)
    return rf"(length({s}) < 2 OR length(regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g')) / greatest(length({s}), 1)::DOUBLE < 0.4)"


def _ocr(x: str) -> str:
    for pattern, replacement in OCR_RULES:
        x = f"regexp_replace({x}, {_q('(?i)' + pattern)}, {_q(replacement)}, 'g')"
    return f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"


LATEST = "latest AS (SELECT id, arg_max(title, updated_at) AS title, arg_max(created_at, updated_at) AS created_at, max(updated_at) AS updated_at FROM conversations WHERE id IS NOT NULL GROUP BY id)"
MSGS = "msgs AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY text, role) = 1)"


FLAT = """SELECT doc_id, string_agg(CASE WHEN np THEN chr(10) || repeat('=', 70) || chr(10) || '--- PAGE ' || page || ' ---' || chr(10) || repeat('=', 70) || chr(10) || chr(10) ELSE '' END || fl, chr(10) ORDER BY item_ord) AS flat,
 string_agg(CASE WHEN np THEN chr(10) || '---' || chr(10) || chr(10) || '**PAGE ' || page || '**' || chr(10) || chr(10) ELSE '' END || md, '' ORDER BY item_ord) AS markdown FROM m GROUP BY doc_id"""
DRAWN = f"""{ITEMS}, m AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY item_ord) IS DISTINCT FROM page AS np, CASE WHEN label IN ('section_header', 'title') THEN repeat('#', least(6, greatest(1, level + 1))) || ' ' || content || chr(10) || chr(10)
 WHEN label = 'list_item' THEN repeat('  ', greatest(0, level - 1)) || CASE WHEN substr(ltrim(content), 1, 1) IN ({", ".join(map(_q, BULLETS))}) THEN '' ELSE '- ' END || content || chr(10)
 WHEN label = 'picture' THEN '**[IMAGE]**' || chr(10) || chr(10) || content || chr(10) || chr(10) ELSE content || chr(10) || chr(10) END AS md,
 '[' || upper(label) || ' | level=' || level || ']' || chr(10) || content || chr(10) AS fl FROM items), drawn AS ({FLAT})"""
_TURN_SQL = f"""{LATEST}, ids AS (SELECT id AS conversation_id FROM latest UNION ALL SELECT 'no-such-id'), t AS (SELECT conversation_id, turn, ('0x' || substr(md5(conversation_id), 1, 6))::BIGINT AS h FROM ids, (VALUES (0), (1)) v(turn)),
 turns AS (SELECT *, (h + turn) % 12 AS n, 'question ' || turn || ' of a rather long conversation' AS question FROM t)"""
ANSWERED = f"""{LEXICAL}, av AS (SELECT avg(dl) AS a FROM dl), qa AS (SELECT qid, unnest({_tokens("text")}) AS term FROM questions), qt AS (SELECT qid, term, count(*) AS times FROM qa GROUP BY ALL),
 sc AS (SELECT qid, chunk_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT a FROM av))))), 9) AS score FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN dl USING (chunk_id) GROUP BY ALL),
 {EXACT[len(CHUNKS) + 2 :]}, {ASKED}, eh AS (SELECT DISTINCT a.qid, e.chunk_id FROM asked a JOIN exact e ON a.kind = e.kind AND a.key = e.key),
 vh AS (SELECT qid, chunk_id, max(score) AS score FROM retrieved_chunks WHERE lower(trim(source)) = 'vector' AND score IS NOT NULL AND isfinite(score) GROUP BY ALL),
 lists AS (SELECT qid, chunk_id, 0 AS place, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS rank FROM eh
 UNION ALL SELECT qid, chunk_id, 1, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) FROM vh
 UNION ALL SELECT * FROM (SELECT qid, chunk_id, 2, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM sc WHERE score > 0 QUALIFY r <= 20)),
 fused_all AS (SELECT qid, chunk_id, coalesce(sum(CASE WHEN place = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(sum(CASE WHEN place = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0)
 + coalesce(sum(CASE WHEN place = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score, min(place * 1000000000 + rank) AS first FROM lists GROUP BY ALL),
 fused AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) AS fused_rank FROM fused_all QUALIFY fused_rank <= 10),
 found AS (SELECT f.qid, f.chunk_id, f.fused_rank, c.text, c.metadata, q.text AS question FROM fused f JOIN chunks c USING (chunk_id) JOIN questions q USING (qid)),
 tok AS (SELECT *, list_distinct({_tokens("question")}) AS qt, list_distinct({_tokens(RERANK)}) AS ct FROM found),
 final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt)::DOUBLE ELSE 0 END DESC, fused_rank) AS rank FROM tok QUALIFY rank <= 5),
 shown AS (SELECT qid, length(string_agg('--- CHUNK [' || chunk_id || '] (Page ' || coalesce(metadata.page_start::VARCHAR, 'None') || ', Section: ' || coalesce(metadata.title, 'None') || ') ---' || chr(10)
 || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank)) AS chars FROM final GROUP BY qid),
 named AS (SELECT qid, list_sort(list(DISTINCT key) FILTER (kind = 'error_codes')) AS error_codes, list_sort(list(DISTINCT key) FILTER (kind = 'model_names')) AS model_names
 FROM (SELECT qid, kind, upper(CASE WHEN kind = 'error_codes' THEN regexp_replace(k, '\\s+', '', 'g') ELSE trim(k) END) AS key FROM asked_raw) GROUP BY qid)"""


def oracle_sql() -> dict[str, str]:
    n = "try_cast(regexp_extract(qid, '([0-9]+)$', 1) AS INT)"
    roman = f"len(list_intersect(list_distinct(regexp_extract_all(lower(text), '\\b[a-zA-Z]+\\b')), [{', '.join(map(_q, ROMAN_URDU))}])) >= 2"
    flat = "array_to_string(path, ' > ') AS path, content, array_to_string(pages::VARCHAR[], ',') AS pages"
    cached = f"{PAGES}, asked AS (SELECT doc_id AS pdf, page_ord, page_num, text, sha256(concat_ws('_', doc_id, page_num, '220', 'v1')) AS cache_key FROM pages)"
    return {
        "tokenize_terms": f"WITH {CHUNKS}, t AS (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM chunks) SELECT term, count(*) AS uses, count(DISTINCT chunk_id) AS chunks FROM t GROUP BY term",
        "bm25_term_stats": f"WITH {LEXICAL} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "bm25_topk": f"""WITH {LEXICAL}, av AS (SELECT avg(dl) AS a FROM dl), qa AS (SELECT qid, unnest({_tokens("text")}) AS term FROM questions), qt AS (SELECT qid, term, count(*) AS times FROM qa GROUP BY ALL),
 sc AS (SELECT qid, chunk_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT a FROM av))))), 9) AS score FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN dl USING (chunk_id) GROUP BY ALL)
 SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20""",
        "embedding_text": f"WITH {CHUNKS} SELECT chunk_id, {EMBEDDING} AS embedding_text FROM chunks",
        "rerank_text": f"WITH {CHUNKS} SELECT chunk_id, {RERANK} AS rerank_text FROM chunks",
        "exact_index_build": f"WITH {EXACT} SELECT kind, key, chunk_id FROM exact",
        "exact_index_stats": f"WITH {EXACT} SELECT kind, count(DISTINCT key) AS keys, count(*) AS entries FROM exact GROUP BY kind",
        "exact_index_export": f"""WITH {EXACT}, p AS (SELECT *, (row_number() OVER (PARTITION BY kind, key ORDER BY chunk_id) - 1) // 10000 + 1 AS part FROM exact)
 SELECT kind, key, part::INT AS part, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM p GROUP BY ALL""",
        "exact_match_lookup": _exact("strict"),
        "exact_match_normalized": _exact("normalized"),
        "vector_topk": f"WITH {VECTORS} SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM pairs QUALIFY rank <= 20",
        "vector_topk_category_fallback": f"""WITH {VECTORS}, c AS (SELECT *, count(*) FILTER (ql = vl AND ql NOT IN ('', 'general')) OVER (PARTITION BY qid) AS same FROM pairs)
 SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM c WHERE same < 3 OR ql = vl QUALIFY rank <= 20""",
        "rrf_fuse": f"WITH {LISTS} SELECT qid, chunk_id, round(score, 9) AS score, fused_rank::INT AS fused_rank FROM fused",
        "rerank_topk": f"WITH {FINAL} SELECT qid, chunk_id, round(score, 6) AS score, 'rerank' AS source, rank::INT AS rank FROM final",
        "rerank_fallback": f"WITH {CHUNKS}, {LISTS} SELECT qid, chunk_id, 0.0::DOUBLE AS score, 'rrf' AS source, fused_rank::INT AS rank FROM fused JOIN chunks USING (chunk_id) WHERE fused_rank <= 5",
        "context_assembly": f"""WITH {FINAL} SELECT qid, string_agg('--- CHUNK [' || chunk_id || '] (Page ' || coalesce(metadata.page_start::VARCHAR, 'None') || ', Section: ' || coalesce(metadata.title, 'None') || ') ---' || chr(10)
 || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS context FROM final GROUP BY qid""",
        "retrieval_stats": f"""WITH {FINAL}, a AS (SELECT qid, count(*) FILTER (source = 'exact') AS exact_hits, count(*) FILTER (source = 'vector') AS vector_hits, count(*) FILTER (source = 'bm25') AS bm25_hits FROM lists GROUP BY qid),
 b AS (SELECT qid, count(*) AS fused FROM fused GROUP BY qid), c AS (SELECT qid, count(*) AS final FROM final GROUP BY qid)
 SELECT a.*, coalesce(fused, 0) AS fused, coalesce(final, 0) AS final FROM a LEFT JOIN b USING (qid) LEFT JOIN c USING (qid)""",
        "parse_pages": f"WITH {PAGES} SELECT doc_id, page_ord, page_num, text FROM pages",
        "divider_pages": f"WITH {PAGES} SELECT doc_id, page_ord, {DIVIDER} AS divider FROM pages",
        "clean_continuations": f"WITH {PAGES} SELECT doc_id, page_ord, {_CLEAN} AS text, regexp_matches({_BARE}, {_q(CONTINUATION)}) AS has_cont FROM pages",
        "heading_sections": f"WITH {SECTIONS} SELECT doc_id, section::BIGINT AS section, {flat} FROM raw_sections",
        "merge_sections": f"WITH {SECTIONS} SELECT doc_id, section::BIGINT AS section, {flat} FROM merged",
        "paragraph_packing": f"""WITH {CHUNKS}, p AS (SELECT chunk_id, {_pack(_TEXT)} AS s FROM chunks), l AS (SELECT chunk_id, list_append(s.done, s.open) AS parts FROM p)
 SELECT chunk_id, (i - 1)::INT AS part, length(parts[i])::INT AS chars, md5(parts[i]) AS digest FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)""",
        "chunk_routing": f"WITH {ROUTED} SELECT doc_id, section::BIGINT AS section, content_type, len(parts)::INT AS parts FROM routed",
        "type_counts": f"""WITH {ROUTED}, parts_ AS (SELECT content_type, array_to_string(path, ' > ') AS title, unnest(parts) AS body FROM routed)
 SELECT content_type, {_category(_strip("regexp_replace(body, chr(10) || '{3,}', chr(10) || chr(10), 'g')"), "title")} AS category, count(*) AS n FROM parts_ GROUP BY ALL""",
        "chunk_ids": f"""WITH {ROUTED}, one AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM routed), c AS (SELECT doc_id, section, i, content_type, pages, array_to_string(path, ' > ') AS title,
 {_strip("regexp_replace(parts[i], chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS text FROM one)
 SELECT 'c_' || doc_id || '_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY section, i))::VARCHAR, 4, '0') AS chunk_id, length(text)::INT AS chars, title, pages[1] AS page_start, pages[-1] AS page_end,
 {_category("text", "title")} AS category, {_section("text", "content_type", "title")} AS section, content_type FROM c""",
        "ingest_report": f"""WITH {ROUTED}, dv AS (SELECT doc_id, page_ord, page_num, {DIVIDER} AS divider FROM pages),
 a AS (SELECT doc_id, count(*) AS total_pages_parsed, coalesce(string_agg(page_num::VARCHAR, ',' ORDER BY page_ord) FILTER (divider), '') AS divider_pages_removed FROM dv GROUP BY doc_id),
 b AS (SELECT doc_id, coalesce(string_agg(page_num::VARCHAR, ',' ORDER BY page_ord) FILTER (has_cont), '') AS continuation_marker_pages FROM clean GROUP BY doc_id),
 c AS (SELECT doc_id, count(*) FILTER (lvl > 0) AS headings_detected FROM lev GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS raw_chunks_before_merge FROM raw_sections GROUP BY doc_id),
 f AS (SELECT doc_id, count(*) AS sections_after_merge, count(*) FILTER (len(parts) = 0) AS tiny_fragments_skipped, nullif(sum(len(parts)), 0)::BIGINT AS total_chunks FROM routed GROUP BY doc_id)
 SELECT m.doc_id, total_pages_parsed, divider_pages_removed, continuation_marker_pages, headings_detected, raw_chunks_before_merge, sections_after_merge, tiny_fragments_skipped, total_chunks
 FROM manuals m LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)""",
        "model_names": f"""WITH {CHUNKS}, s AS (SELECT list(DISTINCT series) AS names FROM product_models WHERE series <> '')
 SELECT chunk_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(upper(text), {_q(MODEL_CODE)}), lambda x: {_strip("x")}),
 list_filter((SELECT names FROM s), lambda n: regexp_matches(upper(text), '\\b' || regexp_escape(n) || '\\b'))))), ',') AS models FROM chunks""",
        "error_codes": f"""WITH {TABLES}, txt AS (SELECT chunk_id, {_TEXT} AS text FROM chunks), allc AS (SELECT chunk_id, upper(replace(unnest(regexp_extract_all(text, {_q(ERROR_CODE)})), ' ', '')) AS code FROM txt
 UNION ALL SELECT chunk_id, '5E' FROM txt WHERE regexp_matches(text, '\\b5E\\b') UNION ALL SELECT chunk_id, code FROM tcodes), d AS (SELECT chunk_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM allc GROUP BY chunk_id)
 SELECT chunk_id, coalesce(codes, '') AS codes FROM txt LEFT JOIN d USING (chunk_id) WHERE text IS NOT NULL""",
        "markdown_table_cells": f"WITH {TABLES} SELECT chunk_id, table_no, row_no, column_no, cell FROM cell",
        "table_codes": f"WITH {TABLES} SELECT chunk_id, code FROM tcodes",
        "content_type": f"WITH {CHUNKS} SELECT chunk_id, {_type('text')} AS content_type FROM chunks",
        "flowchart_flag": f"WITH {CHUNKS} SELECT chunk_id, {_flow('text')} AS flowchart FROM chunks",
        "product_category": f"WITH {CHUNKS} SELECT chunk_id, {_category('text', chr(39) * 2 + ' || coalesce(metadata.title, ' + chr(39) * 2 + ')')} AS category FROM chunks",
        "section_label": f"WITH {CHUNKS}, t AS (SELECT chunk_id, text, coalesce(metadata.title, '') AS title, {_type('text')} AS kind FROM chunks) SELECT chunk_id, {_section('text', 'kind', 'title')} AS section FROM t",
        "ocr_clean": f"WITH {CHUNKS} SELECT chunk_id, {_ocr('text')} AS text FROM chunks",
        "ocr_garbage_filter": f"WITH {OCR} SELECT image_id, count(*) FILTER ({_garbage('text')}) AS garbage, count(*) AS lines FROM oc GROUP BY image_id",
        "ocr_line_agg": f"""WITH {OCR}, s AS (SELECT image_id, line_ord, {_strip("text")} AS t, score FROM oc), k AS (SELECT *, score >= 0.5 AND NOT {_garbage("t")} AS good FROM s WHERE t <> '')
 SELECT image_id, md5(coalesce(string_agg(t, chr(10) ORDER BY line_ord) FILTER (good), '')) AS digest, round(coalesce(avg(score) FILTER (good), 0), 6) AS confidence, count(*) FILTER (NOT good) AS dropped FROM k GROUP BY image_id""",
        "picture_gate": f"""WITH b AS (SELECT *, p_size * 10 AS w, p_size * 7 AS h, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS nn, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS rr FROM part),
 s AS (SELECT *, least(3.0, greatest(1.0, 640.0 / least(w, h))) AS scale, coalesce(nn, '') AS n, coalesce(rr, '') AS r FROM b),
 c AS (SELECT *, length(trim(r)) > length(trim(n)) AS longer, length(trim(n)) >= 20 AS enough FROM s)
 SELECT p_partkey, CASE WHEN scale > 1.05 THEN trunc(w * scale)::INT ELSE w END AS width, CASE WHEN scale > 1.05 THEN trunc(h * scale)::INT ELSE h END AS height,
 w * h >= 16900 AND length(trim(repeat(p_name, p_size))) + length(trim(p_type)) < 250 AS describe, {" OR ".join(f"contains(lower(p_name), {_q(k)})" for k in TABLE_WORDS)} AS likely_table,
 CASE WHEN longer THEN r WHEN enough THEN n ELSE coalesce(nullif(r, ''), n) END AS text,
 CASE WHEN longer THEN 'recognised' WHEN enough THEN 'nested' WHEN trim(r) <> '' THEN 'recognised' WHEN trim(n) <> '' THEN 'nested' ELSE 'none' END AS source,
 CASE WHEN (longer OR NOT enough) AND trim(r) <> '' THEN round(p_retailprice / 10000, 3) END AS confidence,
 coalesce(nullif(concat_ws(chr(10), '[CAPTION] ' || nullif({_ocr("trim(p_brand)")}, ''), '[TEXT IN IMAGE] ' || nullif(trim(rr), '')), ''), '[No extractable content found in image]') AS content FROM c""",
        "interval_gaps": """WITH s AS (SELECT l_orderkey, l_quantity AS lo, l_quantity + l_linenumber * 2 AS hi FROM lineitem),
 r AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT l_orderkey, reach AS lo, lo AS hi FROM r WHERE lo > reach""",
        "page_context": f"""WITH {ITEMS}, s AS (SELECT doc_id, page, item_ord, CASE WHEN label = 'table' THEN '[a technical specification table is on this page]' ELSE trim(content) END AS s FROM items WHERE label NOT IN ('picture', 'image'))
 SELECT doc_id, page, substr(string_agg(s, ' | ' ORDER BY item_ord, s), 1, 600) AS context FROM s GROUP BY ALL""",
        "render_markdown": f"""WITH {ITEMS}, m AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY item_ord) IS DISTINCT FROM page AS np, CASE WHEN label IN ('section_header', 'title') THEN repeat('#', least(6, greatest(1, level + 1))) || ' ' || content || chr(10) || chr(10)
 WHEN label = 'list_item' THEN repeat('  ', greatest(0, level - 1)) || CASE WHEN substr(ltrim(content), 1, 1) IN ({", ".join(map(_q, BULLETS))}) THEN '' ELSE '- ' END || content || chr(10)
 WHEN label = 'picture' THEN '**[IMAGE]**' || chr(10) || chr(10) || content || chr(10) || chr(10) ELSE content || chr(10) || chr(10) END AS md,
 '[' || upper(label) || ' | level=' || level || ']' || chr(10) || content || chr(10) AS fl FROM items)
 SELECT doc_id, string_agg(CASE WHEN np THEN chr(10) || '---' || chr(10) || chr(10) || '**PAGE ' || page || '**' || chr(10) || chr(10) ELSE '' END || md, '' ORDER BY item_ord) AS markdown,
 string_agg(CASE WHEN np THEN chr(10) || repeat('=', 70) || chr(10) || '--- PAGE ' || page || ' ---' || chr(10) || repeat('=', 70) || chr(10) || chr(10) ELSE '' END || fl, chr(10) ORDER BY item_ord) AS flat FROM m GROUP BY doc_id""",
        "flat_text": f"WITH {DRAWN} SELECT doc_id, md5(flat) AS digest, length(flat)::INT AS chars FROM drawn",
        "markdown_with_preamble": f"""WITH {DRAWN}, p AS (SELECT doc_id, max(page) AS pages FROM items GROUP BY doc_id)
 SELECT doc_id, md5('# ' || doc_id || chr(10) || chr(10) || '**Source:** ' || doc_id || '  ' || chr(10) || '**Pages:** ' || pages || '  ' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown) AS digest FROM drawn JOIN p USING (doc_id)""",
        "structured_items": f"""WITH {ITEMS} SELECT doc_id, '{{"source":"' || doc_id || '","total_pages":' || max(page) || ',"total_items":' || count(*) || '}}' AS header, count(*) AS items FROM items GROUP BY doc_id""",
        "item_summary": f"""WITH {ITEMS}, c AS (SELECT doc_id, label, count(*) AS n, max(page) AS page FROM items GROUP BY ALL)
 SELECT doc_id, max(page) AS total_pages, sum(n)::BIGINT AS total_items, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS item_breakdown FROM c GROUP BY doc_id""",
        "table_items": f"""WITH {ITEMS} SELECT doc_id, item_ord, {_ocr("CASE WHEN item_ord % 5 = 0 THEN '[TABLE EXTRACTION PARTIAL — fallback text]' || chr(10) || content || chr(10) || '[Error: no grid]' ELSE '| item | page | text |' || chr(10) || '|:---|:---|:---|' || chr(10) || '| ' || item_ord || ' | ' || page || ' | ' || content || ' |' END")} AS content FROM items WHERE label = 'table'""",
        "nested_picture_text": f"""WITH {ITEMS}, t AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY item_ord) AS text FROM items WHERE item_ord % 3 <> 0 GROUP BY doc_id)
 SELECT doc_id AS picture_id, md5(text) AS digest, trim(substr(text, 1, 8)) AS caption FROM t""",
        "picture_descriptions": """WITH b AS (SELECT p_partkey, p_brand || p_type AS image FROM part), held AS (SELECT DISTINCT image FROM b WHERE p_partkey % 2 = 0)
 SELECT p_partkey, CASE WHEN held.image IS NOT NULL THEN 'held' WHEN strlen(b.image) % 7 <> 0 THEN strlen(b.image) || ' bytes' END AS description FROM b LEFT JOIN held ON held.image = b.image""",
        "page_write_through": f"""WITH {cached}, lacking AS (SELECT cache_key, page_num, min(text) AS text FROM asked WHERE cache_key NOT IN (SELECT cache_key FROM asked WHERE page_num % 2 = 0) GROUP BY ALL),
 body AS (SELECT cache_key, page_num, CASE WHEN page_num % 3 <> 0 THEN {_strip("text")} ELSE '[ERROR] All models failed for this page.' END AS b, page_num % 3 = 0 AS failed FROM lacking)
 SELECT cache_key, md5(CASE WHEN starts_with(b, '## PAGE') THEN b ELSE '## PAGE ' || page_num || chr(10) || chr(10) || b END) AS digest, failed FROM body""",
        "chunk_lookup": f"WITH {CHUNKS} SELECT chunk_id, length(text)::INT AS chars, metadata.section AS section FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM retrieved_chunks WHERE lower(trim(source)) = 'exact')",
        "vector_index_recall": f"WITH {VECTORS}, k AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 20) SELECT count(*) AS neighbours, true AS enough FROM k",
        "answer_batch": f"""WITH {ANSWERED}, u AS (SELECT q.qid, q.text, CASE WHEN {roman} AND lower(coalesce(language, '')) NOT IN ('roman urdu', 'urdu') THEN 'Roman Urdu' ELSE coalesce(language, 'Unknown') END AS language, {roman} AS is_roman_urdu,
 list_filter(coalesce(error_codes, []), lambda x: x <> '') AS error_codes, list_filter(coalesce(model_names, []), lambda x: x <> '') AS model_names, coalesce(intent, 'general') AS intent, nullif(product_category, '') AS product_category, coalesce(confidence, 0.8) AS confidence
 FROM questions q LEFT JOIN named USING (qid))
 SELECT u.qid, u.language, coalesce(chars, 0)::INT AS context_chars, (length('Question (' || u.language || '):' || chr(10) || u.text || chr(10) || chr(10) || 'In English:' || chr(10) || u.text || chr(10) || chr(10) || 'Context:' || chr(10)
 || chr(10) || chr(10) || 'Answer from the context only, in ' || u.language || ', naming the chunks used. If the context does not say, say so.' || chr(10)) + coalesce(chars, 0))::INT AS prompt_chars,
 is_roman_urdu, array_to_string(error_codes, ',') AS error_codes, array_to_string(model_names, ',') AS model_names, intent, product_category, confidence FROM u LEFT JOIN shown USING (qid)""",
        "conversation_newest": f"WITH {LATEST} SELECT id, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at FROM latest",
        "conversation_point_read": f"""WITH {LATEST}, a AS (SELECT DISTINCT conversation_id AS id FROM messages WHERE conversation_id IS NOT NULL UNION SELECT 'no-such-id'),
 f AS (SELECT a.id, regexp_full_match(a.id, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AND latest.id IS NOT NULL AS found, title FROM a LEFT JOIN latest ON latest.id = a.id)
 SELECT id, found, CASE WHEN found THEN title END AS title FROM f""",
        "conversation_create": "SELECT qid AS id, 'New conversation' AS title, '2025-01-02 03:04:05' AS created_at, '2025-01-02 03:04:05' AS updated_at FROM questions",
        "conversation_rename": f"""WITH {LATEST}, {MSGS}, r AS (SELECT conversation_id AS id, substr(text, 1, 20) AS t, created_at AS ts FROM msgs WHERE conversation_id IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, substr(text, 1, 20) DESC) = 1)
 SELECT latest.id, coalesce(t, title) AS title, strftime(coalesce(ts, updated_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at FROM latest LEFT JOIN r ON r.id = latest.id""",
        "chat_append_turns": f"""WITH {_TURN_SQL}, begun AS (SELECT DISTINCT conversation_id FROM messages WHERE conversation_id IS NOT NULL)
 SELECT latest.id, CASE WHEN latest.id IN (SELECT conversation_id FROM begun) THEN title ELSE substr('question 0 of a rather long conversation', 1, 32) END AS title, '2027-01-15 08:00:01' AS updated_at, 4::BIGINT AS added,
 (SELECT count(*) FROM turns WHERE conversation_id = latest.id AND n % 3 = 0) AS empty FROM latest""",
        "chat_client_view": f"""WITH {_TURN_SQL}, sent AS (SELECT * FROM turns WHERE n % 4 <> 0), f AS (SELECT conversation_id, arg_min(n, turn) AS n, arg_min(question, turn) AS q FROM sent GROUP BY conversation_id)
 SELECT s.conversation_id, 2 * count(*) AS messages, count(*) FILTER (s.n % 4 = 1) AS errors, count(*) FILTER (s.n % 4 <> 1 AND s.n % 3 = 0) AS empty, any_value(CASE WHEN f.n % 4 <> 1 THEN substr(q, 1, 32) END) AS title
 FROM sent s JOIN f USING (conversation_id) GROUP BY s.conversation_id""",
        "flag_migration": f"WITH {MSGS} SELECT id, coalesce(is_empty, false) AS is_empty FROM msgs WHERE id IS NOT NULL",
        "label_histogram": f"WITH {ITEMS} SELECT label, count(*) AS n FROM items GROUP BY label",
        "page_cache_miss": f"WITH {cached} SELECT pdf, page_num, cache_key FROM asked WHERE cache_key NOT IN (SELECT cache_key FROM asked WHERE page_num % 2 = 0)",
        "combined_document": f"""WITH {cached}, c AS (SELECT pdf, page_ord, regexp_replace(text, {_q(CHATTER)}, '') AS body, page_num FROM asked)
 SELECT pdf, md5(string_agg(CASE WHEN starts_with(body, '## PAGE') THEN body ELSE '## PAGE ' || page_num || chr(10) || chr(10) || body END, chr(10) ORDER BY page_ord)) AS digest, count(*) AS with_marker FROM c GROUP BY pdf""",
        "roman_urdu_flag": f"SELECT qid, {roman} AS roman_urdu FROM questions",
        "keyword_router": "SELECT qid, CASE WHEN contains(lower(text), 'warrant') THEN 'warranty' WHEN contains(lower(text), 'leave') THEN 'leave' WHEN contains(lower(text), 'order') OR contains(lower(text), 'status') THEN 'order' ELSE 'none' END AS topic FROM questions",
        "understanding_parse": f"""WITH q AS (SELECT *, {n} % 5 <> 0 AS sound, {roman} AS roman FROM questions)
 SELECT qid, text AS translated_query, CASE WHEN sound AND roman AND lower(coalesce(language, '')) NOT IN ('roman urdu', 'urdu') THEN 'Roman Urdu' WHEN sound THEN coalesce(language, 'Unknown') ELSE 'Unknown' END AS language,
 roman AS is_roman_urdu, CASE WHEN sound THEN 'E1' ELSE '' END AS codes, CASE WHEN sound THEN 'AB-2' ELSE '' END AS models, CASE WHEN sound THEN coalesce(intent, 'general') ELSE 'general' END AS intent,
 CASE WHEN sound THEN nullif(product_category, '') END AS product_category, round(CASE WHEN sound THEN coalesce(confidence, 0.8) ELSE 1.0 END, 6) AS confidence FROM q""",
        "latest_conversations": f"WITH {LATEST} SELECT id, title, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at FROM latest",
        "conversation_list": f"""WITH {LATEST}, {MSGS}, pl AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id) - 1) // 200 + 1 AS page FROM msgs WHERE conversation_id IS NOT NULL),
 m AS (SELECT conversation_id, page, count(*) AS n, string_agg(id, ',' ORDER BY created_at NULLS FIRST, id) AS ids FROM pl GROUP BY ALL)
 SELECT latest.id, title, coalesce(page, 1)::INT AS page, coalesce(n, 0)::INT AS messages, coalesce(ids, '') AS message_ids FROM latest LEFT JOIN m ON latest.id = conversation_id""",
        "conversation_titles": """WITH u AS (SELECT * FROM messages WHERE lower(trim(role)) = 'user' AND text IS NOT NULL AND conversation_id IS NOT NULL)
 SELECT conversation_id, substr(text, 1, 32) AS title FROM u QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS LAST, id, text) = 1""",
        "message_mapping": f"""WITH {MSGS} SELECT id, role, text, coalesce(len(sources), 0)::INT AS sources, coalesce(is_empty, false) AS is_empty, false AS is_error,
 strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at FROM msgs""",
        "feedback_last_write": """SELECT id AS message_id, arg_max(feedback, ROW(created_at IS NOT NULL, created_at, feedback)) AS feedback FROM messages WHERE feedback IN ('helpful', 'not_helpful') AND id IS NOT NULL GROUP BY id""",
        "conversation_delete_cascade": f"""WITH {LATEST}, {MSGS} SELECT conversation_id, count(*) AS messages FROM msgs WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT id FROM latest WHERE title = 'New conversation') GROUP BY conversation_id""",
        "valid_messages": f"""WITH {MSGS} SELECT id, lower(trim(role)) AS role, regexp_full_match(id, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AS valid_id,
 CASE WHEN is_empty THEN 'empty' ELSE 'normal' END AS tone FROM msgs WHERE lower(trim(role)) IN ('user', 'assistant') AND regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') <> ''""",
    }
