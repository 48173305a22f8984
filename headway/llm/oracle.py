"""SQL for DuckDB with the rows of those queries that SQL can express."""

from __future__ import annotations

from headway.llm import audit, chat, quality, repair
from headway.llm.base import LOWER, UPPER

_SPLIT = r"'[\x20\x09-\x0D]+'"
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.STOP_WORDS)


def _passes(r: quality.Rule) -> str:
    sides = ([f"{r.ratio} >= {r.low}"] if r.low is not None else []) + ([f"{r.ratio} <= {r.high}"] if r.high is not None else [])
    return f"coalesce({' AND '.join(sides)}, false)"


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), firsts AS (SELECT body, min(page_id) AS lead FROM p GROUP BY body),
bits AS (SELECT p.page_id, p.body, f.lead, array_to_string(list_transform(string_split(sha1(p.body), ''), lambda h: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', h)]), '') AS b
  FROM p JOIN firsts f ON f.body = p.body)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(b, 5 * i + k + 1, 1) AS INT) * [16, 8, 4, 2, 1][k + 1])) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM bits
"""

_TAIL = len(chat.END) + 1
OP4 = f"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, CAST(ceil(octet_length(encode(body)) / 4) AS BIGINT) + 4 AS tokens, length(replace(replace(body, '\\', '\\\\'), '<|', '\\i')) + length(replace(replace(role, '\\', '\\\\'), '<|', '\\i')) + {len(chat.START) + 1 + _TAIL} AS size,
  row_number() OVER w - 1 AS rank, first_value(role) OVER w = 'system' AS has_system FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, body)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) - tokens AS start, CASE WHEN has_system THEN first_value(tokens) OVER (PARTITION BY conv_id ORDER BY rank) ELSE 0 END AS own,
  CASE WHEN has_system THEN first_value(size) OVER (PARTITION BY conv_id ORDER BY rank) ELSE 0 END AS system_size FROM t),
v AS (SELECT *, greatest({chat.BUDGET - chat.HISTORY_TOKENS} - own, 1) AS room, has_system AND rank = 0 AS is_system FROM s),
w AS (SELECT *, CASE WHEN is_system THEN 0 ELSE (start - own) // room + (start - own + tokens - 1) // room END AS win FROM v),
lead AS (SELECT conv_id, win, min(rank) AS first FROM w GROUP BY ALL),
again AS (SELECT l.conv_id, sum(CASE WHEN l.first > 0 THEN a.system_size ELSE 0 END) AS chars FROM lead l JOIN w a ON a.conv_id = l.conv_id AND a.rank = l.first GROUP BY l.conv_id),
past AS (SELECT l.conv_id, sum(h.size) AS chars FROM lead l JOIN w a ON a.conv_id = l.conv_id AND a.rank = l.first
  JOIN w h ON h.conv_id = l.conv_id AND h.rank < l.first AND h.rank >= l.first - {chat.HISTORY_TURNS} AND NOT h.is_system AND a.start - h.start <= {chat.HISTORY_TOKENS} GROUP BY l.conv_id)
SELECT w.conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), body, chr(10)), '' ORDER BY rank)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(body, '' ORDER BY rank) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(any_value(again.chars), 0) + coalesce(any_value(past.chars), 0) AS BIGINT) AS formatted_chars, count(DISTINCT win) AS n_windows
FROM w LEFT JOIN again ON again.conv_id = w.conv_id LEFT JOIN past ON past.conv_id = w.conv_id GROUP BY w.conv_id
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, doc_id, body, list_filter(regexp_split_to_array(body, {_SPLIT}), lambda x: x <> '') AS ws, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM m WHERE c > 1) GROUP BY rid),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(body, '\p{{Lu}}')) AS BIGINT) AS n_upper,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(ws, lambda x: list_contains([{_STOPS}], lower(trim(x, '.,;:!?"''()'))))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  array_to_string(list_filter([{", ".join(f"CASE WHEN n_words > 0 AND NOT {_passes(r)} THEN '{r.name}' END" for r in quality.RULES)}], lambda x: x IS NOT NULL), ', ') AS failed_rules FROM c)
SELECT *, NOT base_failed AND n_words > 0 AND failed_rules = '' AS kept FROM j
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_SPLIT}), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) ELSE array_to_string(ws, ' ') END AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON b.x = a.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN sides l ON l.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = w.doc_id
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, {_SPLIT}), lambda x: x <> '') AS ws FROM d),
m AS (SELECT doc_id, part, CAST(len(ws) < {audit.MIN_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < {audit.DISTINCT_PERCENT} * len(ws) AS INT)
  + 4 * CAST(100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > {audit.UPPER_PERCENT} * length(body) AS INT) + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i, 1) AS letter, CAST(2 ** (i - 1) AS INT) AS bit FROM range(1, 6) r(i)),
o AS (SELECT concat(a.letter, b.letter, x.letter, y.letter, z.letter) AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits FROM f a, f b, f x, f y, f z
  WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS gone FROM o, range(1, 6) r(k)),
t AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in audit.COUNTS[:-1])}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t
"""

#: Of each state (e: nothing, s, u, a) the next one by an edit; from which states an initial may be kept, and to which it leads.
_NEXT = {"e": "u", "s": "u", "u": "a", "a": "u"}
_ROLES = {"u": "user", "a": "assistant"}
_KEEPS = {"s": [("e", "s")], "u": [("e", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}


def _grown(way: str, cost: str, edit: str, line: str | None = None) -> str:
    """A way (cost, audit, repaired text) with one more edit; null ways stay null."""
    text = f"{way}.t" if line is None else f"concat({way}.t, CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END, {line})"
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'w': concat({way}.w, '{edit}'), 't': {text}}} END"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]


def _taken(state: str) -> str:
    """The best way that has just taken a row and ends in ``state``."""
    ways = [f"CASE WHEN NOT must_go AND initial = '{k}' THEN {_grown(f'b.{q}', 'more', 'K', own)} END" for k, moves in _KEEPS.items() for q, to in moves if to == state for own in ["concat(role, ':', body)"]]
    ways += [f"CASE WHEN NOT must_go THEN {_grown(f'b.{q}', f'({repair.REROLE} + more)', 'R', own)} END" for q, to in _NEXT.items() if to == state for own in [f"concat('{_ROLES[to]}:', body)"]]
    return _least(_grown(f"b.{state}", str(repair.DELETE), "D"), *ways)


def _put_in(state: str) -> str:
    """The best way to ``state`` with turns put in after what was taken."""
    return _least(f"n.{state}", *[_grown(f"n.{q}", str(repair.INSERT), "I", f"'{_ROLES[state]}:'") for q, to in _NEXT.items() if to == state])


_CLOSED = "".join(
    f", {name} AS (SELECT n.* EXCLUDE (e, s, u, a), n.e, n.s, {_put_in('u')} AS u, {_put_in('a')} AS a FROM {below} n)" for name, below in (("p1", "taken"), ("p2", "p1"), ("p3", "p2"))
)
_WAY = "STRUCT(c BIGINT, w VARCHAR, t VARCHAR)"
OP13 = rf"""
WITH RECURSIVE steps AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS of FROM steps WHERE k = 8),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, of[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS harm FROM r, crc),
g AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0),
o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(body), copy) AS i, regexp_replace(body, '[ 	-]+$', '') AS bare FROM g),
x AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, body ORDER BY i) > 1 AND bare <> '' AS again, right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM o),
z AS (SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND cut AS truncated, CASE WHEN cut THEN {repair.TRUNCATED} ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM x),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND concat(earlier, initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM z GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
b AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'w': '', 't': ''}}::{_WAY} AS e, NULL::{_WAY} AS s, {_grown("{'c': 0, 'w': '', 't': ''}", str(repair.INSERT), "I", "'user:'")}::{_WAY} AS u,
    {{'c': {2 * repair.INSERT}, 'w': 'II', 't': concat('user:', chr(10), 'assistant:')}}::{_WAY} AS a FROM ids
  UNION ALL (
    WITH taken AS (SELECT b.conv_id, z.i, {", ".join(f"{_taken(q)}::{_WAY} AS {q}" for q in "esua")} FROM b JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.i = b.i + 1){_CLOSED}
    SELECT conv_id, i, e::{_WAY}, s::{_WAY}, u::{_WAY}, a::{_WAY} FROM p3)),
best AS (SELECT ids.conv_id, least(b.e, b.a) AS way FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = coalesce(n.n, 0))
SELECT best.conv_id, {", ".join(f"CAST(coalesce(n.{x}, 0) AS BIGINT) AS {x}" for x in "gaps blank duplicate truncated illegal".split())}, CAST(way.c AS BIGINT) AS cost, way.w AS audit, sha256(way.t) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""

SQL = {"op12_filter_audit": OP12, "op13_conversation_repair": OP13, "op2_warc": OP2, "op4_chat": OP4, "op6_quality": OP6, "op8_jaccard": OP8}
