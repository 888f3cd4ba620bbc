"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from marrow.llm.linededup import ENDS, GAP, GRAM, LONGEST, PIECE, REACH, RUN_LINES, RUN_WORDS, WINDOW
from marrow.llm.quality import FENCES, LEAST_DOCS, LEAST_WIDTH, SOME, TWO_SIDED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = """
WITH t AS (SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'unknown' ELSE translate(replace(replace(role, '<|', '< |'), '|>', '| >'), concat(chr(10), chr(13)), '  ') END AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(floor(turn / 256), -1)::BIGINT AS piece FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t),
x AS (SELECT conv_id, participant, piece, turn, role, text, role = participant AS own,
    CASE WHEN role = participant THEN concat('<|assistant|>', chr(10)) ELSE concat('<|user name=', role, '|>', chr(10)) END AS head,
    concat(text, '<|end|>', chr(10)) AS body FROM t JOIN p USING (conv_id)),
y AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, piece ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM x),
z AS (SELECT conv_id, participant, piece, count(*) AS n_turns, string_agg(concat(head, body), '' ORDER BY turn NULLS FIRST, role, text) AS text,
    coalesce(string_agg(CASE WHEN own THEN concat(place + length(head), '-', place + length(head) + length(body)) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask,
    sum(length(head) + length(body)) AS size FROM y GROUP BY ALL)
SELECT conv_id, participant, piece, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, participant ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin", n_turns, text, mask FROM z
"""

_WORD = r"[^\x20\x09-\x0D]+"
_RULES = {"symbols": "n_symbols * 1000000 // nullif(word_chars, 0)", "dup_lines": "n_dup_lines * 1000000 // greatest(n_lines, 1)", "repeats": "n_repeat_words * 1000000 // nullif(n_words, 0)", "word_length": "word_chars * 1000 // nullif(n_words, 0)"}
_EXP = "greatest(length(bin(v)) - 6, 0)"


def _top(b: str) -> str:
    b = f"({b})"
    e = f"greatest({b} // 32 - 1, 0)"
    return f"(CAST(({b} - {e} * 32 + 1) AS BIGINT) << {e}) - 1"


def _at(k: int) -> str:
    """The bucket that holds a rule's quantile."""
    return f"min(bucket) FILTER (upto * 100 >= total * CASE rule {' '.join(f"WHEN '{r}' THEN {f[k]}" for r, f in FENCES.items())} END)"


_SOME = " ".join(f"WHEN '{r}' THEN {p}" for r, (p, _) in SOME.items())
_BEYOND = f"min(bucket) FILTER (bucket > 0 AND (upto - zero) * 100 >= (total - zero) * CASE rule {_SOME} ELSE 0 END) AS b2"
_ZERO = "sum(CASE WHEN bucket = 0 THEN n ELSE 0 END) OVER (PARTITION BY {0}) AS zero"


def _width(r: str) -> str:
    return f"coalesce(p2, 0) // {SOME[r][1]}" if r in SOME else str(LEAST_WIDTH[r])


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
m AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'{x} AS v_{r}' for r, x in _RULES.items())} FROM m),
s AS (SELECT lang, source, rule, {_EXP} * 32 + (CAST(v AS BIGINT) >> {_EXP}) AS bucket, count(*) AS n FROM (
    {' UNION ALL '.join(f"SELECT lang, source, '{r}' AS rule, CAST(v_{r} AS BIGINT) AS v FROM b WHERE NOT base_failed" for r in _RULES)}) GROUP BY ALL),
w AS (SELECT lang, rule, bucket, sum(n) AS n FROM s GROUP BY ALL),
q AS (SELECT lang, source, rule, max(total) AS total, {_at(0)} AS b0, {_at(1)} AS b1, {_BEYOND} FROM (
    SELECT *, {_ZERO.format('lang, source, rule')}, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM s) GROUP BY ALL),
lq AS (SELECT lang, rule, {_at(0)} AS b0, {_at(1)} AS b1, {_BEYOND} FROM (
    SELECT *, {_ZERO.format('lang, rule')}, sum(n) OVER (PARTITION BY lang, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, rule) AS total FROM w) GROUP BY ALL),
e AS (SELECT q.lang, source, q.rule, {_top('CASE WHEN total < ' + str(LEAST_DOCS) + ' THEN lq.b0 ELSE q.b0 END')} AS p0, {_top('CASE WHEN total < ' + str(LEAST_DOCS) + ' THEN lq.b1 ELSE q.b1 END')} AS p1, {_top('CASE WHEN total < ' + str(LEAST_DOCS) + ' THEN lq.b2 ELSE q.b2 END')} AS p2 FROM q JOIN lq ON q.lang IS NOT DISTINCT FROM lq.lang AND q.rule = lq.rule),
f AS (SELECT lang, source, {', '.join(f"max(p1 + greatest({c} * (p1 - p0), {_width(r)})) FILTER (rule = '{r}') AS fence_{r}, max(p0 - greatest({c} * (p1 - p0), {_width(r)})) FILTER (rule = '{r}') AS least_{r}" for r, (_, _, c) in FENCES.items())} FROM e GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN false ELSE coalesce({' AND '.join([f'v_{r} <= fence_{r}' for r in _RULES] + [f'v_{r} >= least_{r}' for r in TWO_SIDED])}, false) END AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS origin FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""

_FOLDED = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


_HANGING = "concat(chr(10), chr(9), chr(13), chr(11), chr(12), ' ')"


def _run(side: str, list_: str, at: str) -> str:
    """Lines that the list of ``side`` shares with the head's, from its gram to the left (sign -) or right."""
    lo = {"l": f"{list_}[{at} - k + 1 : {at}]", "r": f"{list_}[{at} + {GRAM} + 1 : {at} + {GRAM} + k]"}
    return lo[side]


def _shared(side: str) -> str:
    room = {"l": "k <= p.pos AND k <= p.hpos", "r": f"p.pos + {GRAM} + k <= len(p.lines) AND p.hpos + {GRAM} + k <= len(p.hlines)"}[side]
    return f"list_max(list_filter(range(0, {REACH + 1}), lambda k: {room} AND {_run(side, 'p.lines', 'p.pos')} = {_run(side, 'p.hlines', 'p.hpos')}))"


LINES = rf"""
WITH u AS (SELECT doc_id, text, string_split(regexp_replace(replace(text, chr(10), concat(chr(10), ' ')), '([{ENDS}\n]) ', concat('\1', chr(1)), 'g'), chr(1)) AS whole FROM documents),
a AS (SELECT doc_id, text, flatten(list_transform(whole, lambda p: CASE WHEN strlen(p) > {LONGEST}
    THEN list_transform(range(0, len(string_split(p, ' ')), {PIECE}), lambda i: array_to_string(string_split(p, ' ')[i + 1 : i + {PIECE}], ' ')) ELSE [p] END)) AS parts FROM u),
t AS (SELECT doc_id, i - 1 AS line, parts[i] AS part, CASE WHEN parts[i] LIKE concat('%', chr(10)) THEN trim(parts[i], {_HANGING}) ELSE parts[i] END AS bare FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM a)),
d AS (SELECT doc_id, list(bare ORDER BY line) AS lines, list(least(63, length(bare) - length(replace(bare, ' ', '')) + 1) ORDER BY line) AS counts, list(md5(bare) ORDER BY line) AS numbers FROM t GROUP BY 1),
x AS (SELECT *, list_transform(range(1, len(lines) - {RUN_LINES} + 2), lambda i: list_min(numbers[i : i + {WINDOW} - 1])) AS least FROM d WHERE len(lines) >= {RUN_LINES}),
g AS (SELECT doc_id, unnest(list_filter(range(0, len(lines) - {GRAM} + 1), lambda j: list_contains(least[greatest(j - {WINDOW} + 2, 1) : j + 1], numbers[j + 1]))) AS pos FROM x),
f AS (SELECT doc_id, pos, lines[pos + 1 : pos + {GRAM}] AS gram FROM g JOIN d USING (doc_id)),
h AS (SELECT gram, min(struct_pack(doc_id := doc_id, pos := pos)) AS head FROM f GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT f.doc_id, f.pos, d.lines, d.counts, head.doc_id AS hdoc, head.pos AS hpos, o.lines AS hlines FROM f JOIN h USING (gram) JOIN d ON d.doc_id = f.doc_id JOIN d o ON o.doc_id = head.doc_id WHERE (f.doc_id, f.pos) <> (head.doc_id, head.pos)),
r AS (SELECT *, {_shared('l')} AS l, {_shared('r')} AS r FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(pos - l, pos + {GRAM} + r)) AS line FROM r WHERE doc_id <> hdoc OR pos - l > hpos + r + {GRAM} - 1),
i AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY line) AS chain FROM (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= {GAP} + 1 THEN 0 ELSE 1 END AS gap FROM c)),
k AS (SELECT doc_id, line FROM i JOIN d USING (doc_id) QUALIFY sum(counts[line + 1]) OVER (PARTITION BY doc_id, chain) >= {RUN_WORDS})
SELECT a.doc_id, CASE WHEN a.text IS NULL THEN NULL ELSE coalesce(v.text, '') END AS text, coalesce(v.n_removed, 0) AS n_removed FROM a LEFT JOIN (
    SELECT t.doc_id, replace(string_agg(t.part, ' ' ORDER BY t.line) FILTER (k.line IS NULL), concat(chr(10), ' '), chr(10)) AS text, count(k.line) AS n_removed
    FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND k.line = t.line GROUP BY 1) v USING (doc_id)
"""

ORACLES = {"op4_chat": CHAT, "op7_quality": QUALITY, "op8_warc": WARC, "op9_decontaminate": DECONTAMINATE, "op10_linededup": LINES}
