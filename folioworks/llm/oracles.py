"""DuckDB SQL for the queries that SQL can express.

The others learn a model, tokenise, shuffle by a hash DuckDB lacks or are
approximate; they are tested against brute force, round trips or held-out rows.
"""

_CHAT = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>') AS safe_text,
           replace(replace(replace(replace(role, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>'), ':', '\:') AS safe_role
    FROM said
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS trained,
           string_agg('### ' || role || ': ' || text || '</turn>' || chr(10), '' ORDER BY turn, role, text) AS plain,
           string_agg('### ' || safe_role || ': ' || safe_text || '</turn>' || chr(10), '' ORDER BY turn, role, text) AS safe
    FROM marked GROUP BY conv_id
), parsed AS (
    SELECT *, array_to_string(list_transform(string_split(plain, '</turn>' || chr(10))[:-2], lambda c:
        regexp_replace(regexp_extract(c, '(?s)^### ((?:[^:\\]|\\.)*): (.*)$', 1), '(?s)\\(.)', '\1', 'g') || chr(10) ||
        regexp_replace(regexp_extract(c, '(?s)^### ((?:[^:\\]|\\.)*): (.*)$', 2), '(?s)\\(.)', '\1', 'g') || chr(10)), '') AS back
    FROM whole
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
       CASE WHEN back = turns THEN length(plain) ELSE length(safe) END AS formatted_chars,
       CASE WHEN back = turns THEN 0 ELSE 1 END AS escape_level, true AS identical
FROM parsed
"""

_ARC = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
    FROM pages WHERE page_id IS NOT NULL
), digests AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4),
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                         1 + ((('0x' || substr(hex, 5 * g::INT + 1, 5))::INT >> (15 - 5 * k::INT)) & 31), 1)), '')), '') AS payload_digest
    FROM hashed
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to, true AS intact
FROM firsts
"""

_NEAR = r"""
WITH RECURSIVE said AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), members AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM said
), sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM members x JOIN members y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = d.doc_id
"""

_REPAIR = r"""
WITH RECURSIVE marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                   lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM marked WHERE kind <> 0)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial
    FROM damaged
), faulted AS (
    SELECT *, CASE WHEN bare = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM placed
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(place) AS n
    FROM faulted GROUP BY conv_id
), inserted(state, goal, price, letters, said) AS (
    VALUES ('', '', 0, '', []::VARCHAR[]), ('', 'u', 5, 'I', ['user:']), ('', 'a', 10, 'II', ['user:', 'assistant:']),
           ('s', 's', 0, '', []), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
           ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']),
           ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:'])
), edits(edit, state, initial, goal, price, said) AS (
    SELECT 'D', state, NULL::VARCHAR, state, 2, NULL::VARCHAR FROM (VALUES ('', ''), ('s', ''), ('u', ''), ('a', '')) AS t(state, _)
    UNION ALL SELECT 'R', state, NULL::VARCHAR, goal, 1, said
    FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) AS t(state, goal, said)
    UNION ALL SELECT 'K', state, initial, initial, 0, ''
    FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS t(state, initial)
), walk(conv_id, place, state, best) AS (
    SELECT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} FROM counted
    UNION ALL
    SELECT w.conv_id, f.place, e.goal, min({
        'cost': w.best.cost + i.price + e.price + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
        'audit': w.best.audit || i.letters || e.edit,
        'said': list_concat(list_concat(w.best.said, i.said), CASE e.edit WHEN 'D' THEN [] WHEN 'R' THEN [e.said || ':' || f.text]
                                                               ELSE [f.role || ':' || f.text] END)})
    FROM walk w JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
    JOIN inserted i ON i.state = w.state
    JOIN edits e ON e.state = i.goal AND (e.edit = 'D' OR f.fault IN ('', 'truncated')) AND (e.edit <> 'K' OR e.initial = f.initial)
    GROUP BY w.conv_id, f.place, e.goal
), ended AS (
    SELECT c.conv_id, min({'cost': w.best.cost + i.price, 'audit': w.best.audit || i.letters, 'said': list_concat(w.best.said, i.said)}) AS best
    FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = c.n
    JOIN inserted i ON i.state = w.state WHERE i.goal = 'a' OR (i.goal = '' AND w.state = '') GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_SEARCH = r"""
WITH said AS (
    SELECT doc_id, row_number() OVER () AS k, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM said GROUP BY k),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), found AS (SELECT k, term, count(*) AS tf FROM said SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM found, total GROUP BY term),
scores AS (
    SELECT item_id, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (k), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

_RULES = r"""
WITH said AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k
    FROM documents
), windows AS (
    SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
    FROM said
), repeated AS (
    SELECT k, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT k, unnest([i, i + 1, i + 2]) AS place FROM (SELECT *, count(*) OVER (PARTITION BY k, s) AS c FROM windows) WHERE c > 1)
    GROUP BY k
), lines AS (
    SELECT k, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
    FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM said)
), by_line AS (
    SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines,
           count(*) FILTER (left(bare, 1) IN ('-', '*')) AS n_listed, count(*) FILTER (right(bare, 3) = '...') AS n_trailing
    FROM lines WHERE bare <> '' GROUP BY k
), measured AS (
    SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
           len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered,
           coalesce(n_listed, 0) AS n_listed, coalesce(n_trailing, 0) AS n_trailing
    FROM said LEFT JOIN repeated USING (k) LEFT JOIN by_line USING (k)
), ledger AS (
    SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars > 15 * n_words)::BIGINT
           + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT
           + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (100 * n_lettered < 70 * n_words)::BIGINT
           + 128 * (100 * n_listed > 90 * n_lines)::BIGINT + 256 * (100 * n_trailing > 30 * n_lines)::BIGINT AS failures
    FROM measured
)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM ledger
"""

ORACLES: dict[str, str] = {
    "op2_chat_format": _CHAT, "op3_arc_to_warc": _ARC, "op10_near_duplicates": _NEAR, "op11_repair": _REPAIR,
    "op12_ranked_search": _SEARCH, "op13_quality_rules": _RULES}
