"""SQL that states the same results for another engine, where SQL can express them."""

from __future__ import annotations

from lodestone.llm.conversations import ASSISTANT_NAMES, STAND_INS, SYSTEM_NAMES, USER_NAMES


def _names(names: tuple[str, ...]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_RANKED = r"""rows AS (SELECT qid, lower(regexp_replace(source, '[^\p{L}\p{N}]+', '', 'g')) AS source, chunk_id, CASE WHEN isfinite(score) THEN score END AS score, retrieved_at FROM retrieved_chunks
 WHERE qid IS NOT NULL AND chunk_id IS NOT NULL AND regexp_matches(source, '[\p{L}\p{N}]')),
 last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY qid, source, chunk_id ORDER BY retrieved_at DESC NULLS LAST, score DESC NULLS LAST) = 1),
 hits AS (SELECT qid, source, chunk_id, score, rank() OVER w + (count(*) OVER (PARTITION BY qid, source, score) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY qid, source) AS k
 FROM last WHERE score IS NOT NULL WINDOW w AS (PARTITION BY qid, source ORDER BY score DESC)),
 n AS (SELECT qid, count(DISTINCT chunk_id) AS n FROM hits GROUP BY qid), src AS (SELECT DISTINCT qid, source, k FROM hits), cand AS (SELECT DISTINCT qid, chunk_id FROM hits),
 points AS (SELECT cand.qid, cand.chunk_id, sum(n - coalesce(r, (src.k + 1 + n) / 2.0::DOUBLE)) AS points FROM cand JOIN src ON src.qid = cand.qid JOIN n ON n.qid = cand.qid
 LEFT JOIN hits ON hits.qid = cand.qid AND hits.source = src.source AND hits.chunk_id = cand.chunk_id GROUP BY ALL),
 placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, chunk_id) AS position FROM points)"""

_TURNS = rf"""named AS (SELECT DISTINCT id, conversation_id, text, created_at, lower(regexp_replace(role, '^[\s\p{{P}}]+|[\s\p{{P}}]+$', '', 'g')) AS name FROM messages WHERE id IS NOT NULL),
 told AS (SELECT id, conversation_id, created_at, text, CASE WHEN name IN ({_names(USER_NAMES)}) THEN 'user' WHEN name IN ({_names(ASSISTANT_NAMES)}) THEN 'assistant' WHEN name IN ({_names(SYSTEM_NAMES)}) THEN 'system' END AS speaker,
 lower(regexp_replace(text, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) AS core FROM named WHERE conversation_id IS NOT NULL),
 turns AS (SELECT * FROM told WHERE coalesce(speaker, '?') <> 'system' AND core <> '' AND core NOT IN ({_names(STAND_INS)})),
 seq AS (SELECT conversation_id, id, text, created_at, speaker, row_number() OVER w AS turn, lead(speaker) OVER w AS following FROM turns
 WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at NULLS LAST, (coalesce(speaker, '?') <> 'user')::INT, id)),
 ids AS (SELECT id AS conversation_id FROM conversations WHERE id IS NOT NULL UNION SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL),
 facts AS (SELECT conversation_id, bool_or(created_at IS NULL OR speaker IS NULL) AS unclear, bool_or(turn = 1 AND coalesce(speaker, '?') <> 'user') AS starts_wrong,
 bool_or(coalesce(speaker, '?') = 'user' AND coalesce(following, '?') <> 'assistant') AS missing FROM seq GROUP BY conversation_id),
 reasons AS (SELECT ids.conversation_id, CASE WHEN facts.conversation_id IS NULL THEN 'empty'
 WHEN ids.conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL) OR unclear OR starts_wrong THEN 'broken' WHEN missing THEN 'missing_reply' END AS reason FROM ids LEFT JOIN facts USING (conversation_id))"""

_EOL = r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
_BIG = rf"""big AS (SELECT DISTINCT chunk_id, text FROM phase1_chunks WHERE length(text) > 4000),
 para AS (SELECT chunk_id, regexp_replace(p, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS p FROM (SELECT chunk_id, unnest(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '{_EOL}(?:[ \t]*{_EOL})+')) AS p FROM big)),
 sent AS (SELECT chunk_id, unnest(string_split(regexp_replace(p, '([.!?۔])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM para),
 word AS (SELECT chunk_id, unnest(regexp_split_to_array(s, '[\s\p{{Z}}]+')) AS w FROM sent)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_RANKED} SELECT qid, chunk_id FROM placed WHERE position = 1",
        "p1_ranking": f"WITH {_RANKED} SELECT qid, chunk_id, points, position FROM placed",
        "p3_found": f"WITH {_TURNS} SELECT conversation_id, reason FROM reasons WHERE reason IS NOT NULL",
        "p3_conversations": f"WITH {_TURNS} SELECT conversation_id, turn, id AS message_id, speaker, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at, text FROM seq WHERE conversation_id NOT IN (SELECT conversation_id FROM reasons WHERE reason IS NOT NULL)",
        "p6_cover": "SELECT DISTINCT chunk_id, true AS whole, true AS fits, true AS overlaps FROM phase1_chunks WHERE length(text) > 4000",
        "p6_found": f"""WITH {_BIG}, a AS (SELECT chunk_id, max(length(p)) AS p FROM para GROUP BY chunk_id), b AS (SELECT chunk_id, max(length(s)) AS s FROM sent GROUP BY chunk_id), c AS (SELECT chunk_id, max(length(w)) AS w FROM word GROUP BY chunk_id)
 SELECT chunk_id, CASE WHEN p <= 4000 THEN 'paragraph' WHEN s <= 4000 THEN 'sentence' WHEN w <= 4000 THEN 'word' ELSE 'none' END AS boundary FROM a JOIN b USING (chunk_id) JOIN c USING (chunk_id)""",
    }
