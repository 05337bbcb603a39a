"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import EDGE, SENTENCE_ENDS, UNITS
from .license_templates import TEMPLATES
from .quality_rules import READER, STOCK, TOPIC

#: Words and lines as the operators see them; blank texts have none.
_WORDS = r"CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') END"

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT r, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1], w[i + 2], w[i + 3]) AS n FROM t),
p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM p GROUP BY r),
ls AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM ls),
m AS (SELECT r, line, s, len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) AS n,
        len(s) - len(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS sym, len(s) - len(replace(s, '|', '')) AS bars,
        regexp_matches(s, '[.!?:;…。！？]["''”’»)\]]*$') AS ended,
        len(s) - len(regexp_replace(s, '[.!?…。！？]', '', 'g')) AS marks,
        regexp_matches(lower(s), '{STOCK}') AS stock, regexp_matches(lower(s), '{TOPIC}') AS topic, regexp_matches(lower(s), '{READER}') AS reader
      FROM l WHERE s <> ''),
v AS (SELECT *, NOT (sym > 0.3 * n OR (bars >= 2 AND bars > 0.2 * n) OR (n >= 8 AND upper(s) = s AND lower(s) <> s)
        OR ((n < 3 OR (n > 40 AND 40 * marks < n)) AND NOT ended) OR (n <= 30 AND (stock OR (topic AND (NOT ended OR reader))))) AS ok FROM m),
la AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(len(line)) AS c, coalesce(sum(len(line)) FILTER (ok), 0) AS kept_c FROM v GROUP BY r),
q AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(la.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(la.c, 0) AS c, coalesce(la.kept_c, 0) AS kept_c
      FROM d LEFT JOIN rep USING (r) LEFT JOIN la USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND c - kept_c <= 0.5 * c AS kept
FROM q
"""

#: Targets: those above the level that the rest share stop at three times their size.
_OP10 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS pos,
        sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER u, 0)) / (weights - coalesce(sum(w) OVER u, 0)) AS level FROM o
      WINDOW u AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, min(pos) FILTER (cap >= level * w) OVER () AS first_at FROM f),
t AS (SELECT source, source_size, CASE WHEN pos < coalesce(first_at, pos + 1) THEN cap ELSE w * max(level) FILTER (pos = first_at) OVER () END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-9)) ELSE 0 END AS copies FROM t),
n AS (SELECT *, greatest(0, target - copies * source_size) AS need FROM p),
c AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
b AS (SELECT c.source, c.h, c.words, n.need, sum(c.words) OVER (PARTITION BY c.source ORDER BY c.h) - c.words AS before
      FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE n.copies < 3),
e AS (SELECT source, h AS edge, need - before AS rest FROM b WHERE before <= need AND before + words > need),
f2 AS (SELECT b.source, arg_min(b.h, (abs(b.words - e.rest), b.h)) AS extra FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source WHERE b.h >= e.edge AND abs(b.words - e.rest) < e.rest GROUP BY b.source),
x AS (SELECT b.source, b.h, b.before + b.words <= b.need OR b.h = coalesce(f2.extra, -1) AS chosen FROM b LEFT JOIN f2 ON b.source IS NOT DISTINCT FROM f2.source)
SELECT d.doc_id, d.size, n.source_size, n.target, CAST(d.size * (n.copies + CASE WHEN coalesce(x.chosen, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

#: Orders come from SQL as well; E by the least id of each text.
_OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
          CASE WHEN 100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * len(text) THEN 'C' END,
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
      FROM d LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM r GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
w AS (SELECT part, fails, good, toxic, n, filter_order, coalesce(list_min([strpos(filter_order, y) FOR y IN string_split(fails, '') IF y <> '']), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, step, filter_order[step] AS x, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM w, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""

#: Sessions begin at hard breaks, and then again and again at the first click that is too far from the start.
_OP12 = """
WITH RECURSIVE k AS (SELECT click_id, client_id, epoch_us(ts) AS us, coalesce(arrived_at - ts > INTERVAL 60 MINUTE, false) AS late,
        coalesce(kind = 'purchase' AND value >= 60, false) AS final, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
      FROM (SELECT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id) = 1)),
t AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, coalesce(lag(final) OVER w, true) OR us - lag(us) OVER w >= 300000000 AS brk FROM k WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
h AS (SELECT *, min(CASE WHEN brk THEN rn END) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hard FROM t),
f AS (SELECT client_id AS c, us AS u, min(rn) AS r FROM t GROUP BY ALL),
n AS MATERIALIZED (SELECT h.client_id, h.rn, CASE WHEN f.r < coalesce(h.hard, f.r + 1) THEN f.r END AS nxt FROM h ASOF LEFT JOIN f ON h.client_id = f.c AND h.us + 7200000000 < f.u),
s AS (SELECT client_id, rn FROM t WHERE brk UNION ALL SELECT s.client_id, n.nxt FROM s JOIN n USING (client_id, rn) WHERE n.nxt IS NOT NULL),
e AS (SELECT client_id, rn AS a, lead(rn) OVER (PARTITION BY client_id ORDER BY rn) AS b FROM s),
g AS (SELECT e.client_id, e.a, e.b, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents) AS value_cents, arg_max(final, rn) AS fin, string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY rn) AS path, arg_min(click_id, rn) AS session_id
      FROM e JOIN t ON t.client_id = e.client_id AND t.rn >= e.a AND t.rn < coalesce(e.b, t.rn + 1) GROUP BY ALL),
o AS (SELECT client_id, start_us, max(a) AS a FROM g GROUP BY ALL),
l AS (SELECT o.client_id, o.a, count(*) AS n_late FROM (SELECT * FROM k WHERE late) k ASOF JOIN o ON k.client_id = o.client_id AND k.us >= o.start_us GROUP BY ALL)
SELECT g.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, CAST(value_cents AS BIGINT) AS value_cents,
  CASE WHEN fin THEN 'end' WHEN g.b IS NULL THEN 'none' WHEN x.us - g.end_us >= 300000000 THEN 'gap' ELSE 'length' END AS closed_by, sha256(path) AS path_sha256
FROM g LEFT JOIN l ON g.client_id = l.client_id AND g.a = l.a LEFT JOIN t x ON x.client_id = g.client_id AND x.rn = g.b
"""

_OP13 = rf"""
WITH RECURSIVE d AS (SELECT r, doc_id, w FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents) t, LATERAL (SELECT {_WORDS} AS w)),
k AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM d),
n AS MATERIALIZED (SELECT min(doc_id) AS id, md5(array_to_string(s, chr(10))) AS m, any_value(s) AS s, any_value(len(s)) AS n FROM k WHERE len(s) > 0 GROUP BY m),
u AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM n),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT id AS a, id AS b FROM n WHERE id IN (SELECT a FROM e) UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
h AS (SELECT a, min(b) AS least FROM c GROUP BY a)
SELECT k.doc_id, CAST(len(k.s) AS BIGINT) AS n_shingles, coalesce(h.least, n.id, k.doc_id) AS component_id, k.doc_id = coalesce(h.least, n.id, k.doc_id) AS kept
FROM k LEFT JOIN n ON len(k.s) > 0 AND n.m = md5(array_to_string(k.s, chr(10))) LEFT JOIN h ON h.a = n.id
"""

ORACLES = {"op7_quality_rules": _OP7, "op10_mixing": _OP10, "op11_filter_audit": _OP11, "op12_sessions": _OP12, "op13_minhash": _OP13}


def _license_scan(least: float = 0.8) -> str:
    """Containment in the whole document; notices lie in one place, so that is the same."""
    rows = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH t AS (SELECT template_id, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {rows}) v(template_id, license, text)),
ts AS (SELECT DISTINCT template_id, license, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS i FROM t WHERE len(w) >= 5)),
n AS (SELECT template_id, count(*) AS n FROM ts GROUP BY template_id),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5))
SELECT doc_id, CAST(template_id AS INT) AS template_id, license, CAST(count(*) AS DOUBLE) / n AS containment
FROM ts JOIN n USING (template_id) JOIN ds USING (s) GROUP BY doc_id, template_id, license, n HAVING CAST(count(*) AS DOUBLE) / n >= {least}
"""


ORACLES["op4_license_scan"] = _license_scan()


def _decontamination(window: int = 8, literal: int = 4, least: float = 0.5, run: int = 13) -> str:
    """Token by token, window by window; windows join as texts instead of hashes.  Items that are one window, or have
    none of enough literal tokens, are left to a test, as the given benchmark has none."""
    quote = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    edge = EDGE.replace("'", "''")
    return rf"""
WITH s AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(coalesce(text, ''), '\S+') AS ws FROM s),
u AS (SELECT side, id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM w),
c AS (SELECT *, CASE WHEN trim(w, '{edge}') = '' THEN w ELSE trim(w, '{edge}') END AS core, coalesce(lag(right(w, 1)) OVER (PARTITION BY side, id ORDER BY p) IN ({quote(sorted(SENTENCE_ENDS))}), true) AS first FROM u),
r AS (SELECT *, regexp_extract(core, '^([$€£¥]?)([+-]?[0-9][0-9.,:/]*)([a-zA-Z%°µ²³/]{{0,6}})$', ['cur', 'num', 'unit']) AS m FROM c),
k AS (SELECT *, CASE WHEN m.num <> '' AND (m.cur <> '' OR m.unit = '' OR lower(m.unit) IN ({quote(sorted(UNITS))})) THEN 1 WHEN len(core) > 2 AND lower(core) IN ({quote(sorted(UNITS))}) THEN 3
        WHEN NOT first AND regexp_full_match(core, '\p{{Lu}}[^\p{{Lu}}\p{{Lt}}]*\p{{Ll}}[^\p{{Lu}}\p{{Lt}}]*') THEN 2 ELSE 0 END AS kind FROM r),
g AS (SELECT side, id, list(CASE kind WHEN 1 THEN '<num' || m.cur || CASE WHEN m.unit = '' THEN '' ELSE 'u' END || '>' WHEN 2 THEN '<name>' WHEN 3 THEN '<unit>' ELSE lower(core) END ORDER BY p) AS t, list(kind ORDER BY p) AS ks,
        list(kind || trim(w, '{edge}') ORDER BY p) AS v FROM k GROUP BY side, id),
l AS (SELECT DISTINCT least({window}, len(t)) AS n FROM g WHERE side = 1),
a AS (SELECT side, id, t, ks, v, n, unnest(range(1, len(t) - n + 2)) AS i FROM g JOIN l ON len(t) >= n AND (side = 0 OR n = least({window}, len(t)))),
x AS (SELECT side, id, n, i, array_to_string(t[i:i + n - 1], ' ') AS h, [v[z] FOR z IN range(i, i + n) IF ks[z] <> 0] AS slots FROM a WHERE len([z FOR z IN range(i, i + n) IF ks[z] = 0]) >= least({literal}, n)),
b AS (SELECT * FROM x WHERE side = 1),
total AS (SELECT id AS item_id, count(*) AS item_windows FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, d.i - b.i AS lag, b.i AS place, d.slots, b.slots AS item_slots FROM x d JOIN b ON d.side = 0 AND d.n = b.n AND d.h = b.h WHERE len(d.slots) = len(b.slots)),
sl AS (SELECT DISTINCT doc_id, item_id, lag, unnest(slots) AS mine, unnest(item_slots) AS theirs FROM m),
bad AS (SELECT doc_id, item_id, lag, theirs FROM sl GROUP BY ALL HAVING count(*) > 1),
back AS (SELECT doc_id, item_id FROM bad UNION SELECT doc_id, item_id FROM (SELECT doc_id, item_id, lag, mine FROM sl GROUP BY ALL HAVING count(*) > 1)),
bl AS (SELECT doc_id, item_id, lag, list(theirs) AS ts FROM bad GROUP BY ALL),
e AS (SELECT m.*, m.slots <> m.item_slots AND list_has_any(m.item_slots, coalesce(ts, []::VARCHAR[])) AS flaw FROM m LEFT JOIN bl USING (doc_id, item_id, lag)),
isl AS (SELECT doc_id, item_id, lag, place - row_number() OVER (PARTITION BY doc_id, item_id, lag ORDER BY place) AS g FROM (SELECT DISTINCT doc_id, item_id, lag, place FROM e WHERE NOT flaw)),
runs AS (SELECT doc_id, item_id, max(n) AS longest FROM (SELECT doc_id, item_id, lag, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
f AS (SELECT doc_id, item_id, count(DISTINCT place) FILTER (NOT flaw) AS matched, any_value(item_windows) AS item_windows, count(DISTINCT place) FILTER (NOT flaw) / any_value(item_windows) AS coverage,
  CAST(max(len(slots)) AS INT) AS slots FROM e JOIN total USING (item_id) GROUP BY doc_id, item_id)
SELECT f.*, NOT EXISTS (SELECT 1 FROM back WHERE back.doc_id = f.doc_id AND back.item_id = f.item_id) AS consistent
FROM f JOIN runs USING (doc_id, item_id) WHERE coverage >= {least} OR longest + {window} - 1 >= {run}
"""


ORACLES["op5_decontamination"] = _decontamination()
