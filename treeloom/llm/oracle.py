"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

# deletes space, \t \n \v \f \r
_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP4 = f"""
WITH t AS (
  SELECT doc_id, sha256({_NORMAL}) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""




def _shares(nodes: str, family: str, name: str, out: str) -> str:
    """CTEs that deal each family's ``total`` to its members by weight, none beyond its capacity."""
    return f"""
{out}_1 AS (
  SELECT *, capacity / weight AS ratio, least(total, sum(capacity) OVER (PARTITION BY {family})) AS amount FROM {nodes}
), {out}_2 AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {family} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (PARTITION BY {family} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM {out}_1
), {out}_3 AS (SELECT *, capacity * onward <= (amount - before) * weight AS full_ FROM {out}_2
), {out}_4 AS (
  SELECT *, amount - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER (PARTITION BY {family}) AS rest,
         sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {family}) AS open_weight
  FROM {out}_3
), {out}_5 AS (
  SELECT *, CASE WHEN full_ THEN capacity ELSE (rest::HUGEINT * weight::HUGEINT) // open_weight::HUGEINT END AS floor_,
         row_number() OVER (PARTITION BY {family}, full_ ORDER BY {name}) AS turn_ FROM {out}_4
), {out} AS (
  SELECT * EXCLUDE (floor_), floor_ + CASE WHEN NOT full_ AND turn_ <=
           rest - sum(CASE WHEN full_ THEN 0 ELSE floor_ END) OVER (PARTITION BY {family}) THEN 1 ELSE 0 END AS budget
  FROM {out}_5
)"""


_NUMBER = r"coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0)"

OP9 = rf"""
WITH t AS (
  SELECT doc_id, ['books', 'code', 'forum', 'web'][{_NUMBER} % 4 + 1] AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens) AS supply, 3 * sum(n_tokens) AS capacity, [2, 3, 1, 5][{_NUMBER} % 4 + 1] AS w1,
         CASE WHEN lang = 'en' THEN 6 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS w2, 1 + {_NUMBER} % 3 AS w3
  FROM t GROUP BY ALL HAVING sum(n_tokens) > 0
), whole_ AS (SELECT sum(n_tokens)::HUGEINT * 600 // 1000 AS total FROM t
), n1 AS (SELECT 0 AS root, domain, sum(capacity) AS capacity, max(w1) AS weight, any_value(total) AS total FROM leaf, whole_ GROUP BY domain
), {_shares("n1", "root", "domain", "d1")}, n2 AS (
  SELECT domain, lang, sum(l.capacity) AS capacity, max(w2) AS weight, any_value(d1.budget) AS total
  FROM leaf l JOIN d1 USING (domain) GROUP BY domain, lang
), {_shares("n2", "domain", "lang", "d2")}, n3 AS (
  SELECT domain, lang, source, l.capacity, l.w3 AS weight, d2.budget AS total FROM leaf l JOIN d2 USING (domain, lang)
), {_shares("n3", "domain, lang", "source", "d3")}, plan AS (
  SELECT domain, lang, source, supply, budget, budget // supply AS whole, budget % supply AS rest
  FROM d3 JOIN leaf USING (domain, lang, source) WHERE budget > 0
), rows_ AS (
  SELECT t.*, supply, budget, rest, whole, unnest(range(0, (whole + 1)::BIGINT)) AS epoch FROM t JOIN plan USING (domain, lang, source)
), keyed AS (
  SELECT *, md5('17:' || epoch::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM rows_
), summed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY order_key, n_tokens
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, order_key, n_tokens::BIGINT AS n_tokens, supply::BIGINT AS leaf_supply,
       budget::BIGINT AS leaf_budget
FROM summed WHERE epoch < whole OR before < rest
"""

OP10 = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS call_id, (conv_id + turn) % 6 AS kind,
         ['search', 'fetch', 'calculate', 'translate', 'erase'][(conv_id * 7 + turn) % 5 + 1] AS name,
         to_json(coalesce(text, ''))::VARCHAR AS query, length(coalesce(text, '')) % 50 AS lim,
         CASE WHEN (conv_id + turn) % 6 = 4 THEN turn + 2 WHEN turn >= 3 THEN turn - 2 END AS pred
  FROM conversations WHERE role = 'assistant'
), has AS (
  SELECT k.*, p.turn AS found FROM k LEFT JOIN k p ON p.conv_id = k.conv_id AND p.turn = k.pred AND k.kind <> 3
), walk AS (
  SELECT conv_id, turn, turn AS at, 0 AS n FROM k
  UNION ALL
  SELECT w.conv_id, w.turn, h.found, n + 1 FROM walk w JOIN has h ON h.conv_id = w.conv_id AND h.turn = w.at
  WHERE h.found IS NOT NULL AND n < 40
), lev AS (SELECT conv_id, turn, CASE WHEN max(n) = 40 THEN -1 ELSE max(n) END AS level FROM walk GROUP BY ALL
), facts AS (
  SELECT h.*, level, 'c' || conv_id || '_' || pred AS pred_id,
         CASE WHEN kind = 3 THEN NULL ELSE '{'
           || CASE WHEN pred IS NULL THEN '' ELSE '"after":["c' || conv_id || '_' || pred || '"],' END
           || CASE WHEN kind = 2 THEN '"debug":[1,{"a":true,"b":null}],' ELSE '' END
           || CASE WHEN kind = 0 THEN '"limit":"' || lim || '",' WHEN kind = 1 THEN '' ELSE '"limit":' || lim || ',' END
           || '"query":' || query || '}' END AS arguments,
         list_sort(list_filter([
           CASE WHEN kind = 3 THEN 'arguments' END,
           CASE WHEN name = 'erase' THEN 'tool' END,
           CASE WHEN kind = 1 AND name IN ('search', 'fetch') THEN 'missing:limit' END,
           CASE WHEN kind = 0 AND name IN ('search', 'fetch', 'calculate') THEN 'type:limit' END,
           CASE WHEN kind IN (2, 4, 5) AND name = 'translate' THEN 'type:limit' END,
           CASE WHEN kind IN (2, 4, 5) AND name = 'fetch' AND lim >= 30 THEN 'value:limit' END,
           CASE WHEN kind = 2 AND name <> 'erase' THEN 'undeclared:debug' END,
           CASE WHEN kind <> 3 AND pred IS NOT NULL AND found IS NULL THEN 'after:c' || conv_id || '_' || pred END
         ], lambda x: x IS NOT NULL)) AS errors
  FROM has h JOIN lev USING (conv_id, turn)
), res AS (
  SELECT conv_id, turn, 'c' || conv_id || '_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'user' AND turn >= 1
)
SELECT conv_id, turn, 0 AS part, 0 AS level, NULL::VARCHAR AS call_id, 'ok' AS status,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' AS json
FROM conversations
UNION ALL
SELECT f.conv_id, f.turn, 1, level, f.call_id,
       CASE WHEN level < 0 THEN 'cycle' WHEN len(errors) > 0 THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END,
       '{"arguments":' || coalesce(arguments, 'null') || ',"errors":' || to_json(errors)::VARCHAR || ',"id":"' || f.call_id
         || '","level":' || level || ',"name":"' || name || '","type":"call"}'
FROM facts f LEFT JOIN res r ON r.conv_id = f.conv_id AND r.call_id = f.call_id
UNION ALL
SELECT r.conv_id, r.turn, 2, coalesce(level, -1), r.call_id, CASE WHEN f.call_id IS NULL THEN 'orphan' ELSE 'ok' END,
       '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || r.call_id || '","type":"result"}'
FROM res r LEFT JOIN facts f ON f.conv_id = r.conv_id AND f.call_id = r.call_id
"""


def _field(value: str) -> str:
    text = f"({value})::VARCHAR"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _tree(nodes: str) -> str:
    """All nodes above ``nodes(key, level, pos, digest, n)``; n is the number of nodes on the level."""
    return f"""
  SELECT * FROM {nodes}
  UNION ALL
  SELECT key, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM t_
  WHERE n > 1 GROUP BY key, level, pos // 2, n"""


# CRC-32 of the decimal digits of doc_id: nine steps a digit, the first takes the digit in, eight shift a bit out
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT)"""

OP11 = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS key, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars::HUGEINT + 1")} END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY key) AS n FROM rows_
), base AS (SELECT key, 0 AS level, pos, leaf AS digest, n FROM placed
), low AS ({_tree("base").replace("t_", "low")}
), tops AS (
  SELECT '' AS key, 0 AS level, row_number() OVER (ORDER BY key) - 1 AS pos, digest, count(*) OVER () AS n, key AS lang_key
  FROM low WHERE n = 1
), top_base AS (SELECT key, level, pos, digest, n FROM tops
), high AS ({_tree("top_base").replace("t_", "high")}
), way AS (
  SELECT p.key, p.pos AS leaf_pos, s.level AS step, s.pos AS own, b.digest AS beside
  FROM placed p JOIN low s ON s.key = p.key AND s.pos = p.pos // (1::BIGINT << s.level) AND s.n > 1
  LEFT JOIN low b ON b.key = s.key AND b.level = s.level AND b.pos = xor(s.pos, 1)
  UNION ALL
  SELECT p.key, p.pos, 100 + s.level, s.pos, b.digest
  FROM placed p JOIN tops t ON t.lang_key = p.key
  JOIN high s ON s.pos = t.pos // (1::BIGINT << s.level) AND s.n > 1
  LEFT JOIN high b ON b.level = s.level AND b.pos = xor(s.pos, 1)
), steps AS (
  SELECT key, leaf_pos, row_number() OVER (PARTITION BY key, leaf_pos ORDER BY step) AS nth, own, beside FROM way
), proof AS (
  SELECT key, leaf_pos, sha256(coalesce(string_agg(beside, '' ORDER BY nth), '')) AS proof_sha256 FROM steps GROUP BY ALL
), fold AS (
  SELECT key, pos, 0 AS done, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.key, f.pos, done + 1,
         sha256(CASE WHEN s.own % 2 = 1 THEN coalesce(beside, '') ELSE '' END || digest || CASE WHEN s.own % 2 = 0 THEN coalesce(beside, '') ELSE '' END)
  FROM fold f JOIN steps s ON s.key = f.key AND s.leaf_pos = f.pos AND s.nth = f.done + 1
), ends AS (SELECT key, pos, max_by(digest, done) AS folded_root FROM fold GROUP BY ALL)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = r.digest AS verified
FROM placed p JOIN ends e ON e.key = p.key AND e.pos = p.pos JOIN tops t ON t.lang_key = p.key
LEFT JOIN proof f ON f.key = p.key AND f.leaf_pos = p.pos, (SELECT digest FROM high WHERE n = 1) r
"""


def sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4, "op9_mixing": OP9, "op10_chat": OP10, "op11_merkle": OP11}
