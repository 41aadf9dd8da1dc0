"""SQL twins of those queries whose rows SQL can express."""

from __future__ import annotations

from perkline.llm.chat_format import CONTROL, END, START
from perkline.llm.fingerprint import BUCKETS, LENGTH_MOST, MOST, MULTIPLIERS, TURN
from perkline.llm.license_scan import COVER, NOTICE_K, NOTICES, PHRASE_K, PHRASES, SLACK, license_words
from perkline.llm.secret_scan import EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_BITS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
z AS (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class_id, count(*) OVER (PARTITION BY g) AS n_copies FROM z),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.component_id, coalesce(k.class_id, doc_id) AS class_id, coalesce(k.n_copies, 1) AS n_copies
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP3 = """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, i, floor(256 * x) AS q FROM e WHERE vec_id NOT IN (SELECT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.q * b.q)::BIGINT AS score FROM v a JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BODY = "replace(text, '\\', '\\\\')"
for _c in CONTROL:
    _BODY = f"replace({_BODY}, {_quoted(_c)}, {_quoted(_c[0] + chr(92) + _c[1:])})"
_HELD = " OR ".join(f"contains(role || chr(10) || text, {_quoted(c)})" for c in CONTROL)

OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
r AS (SELECT *, {_HELD} OR contains(role, chr(10)) OR starts_with(role, '\\') AS kept FROM c),
f AS (SELECT *, {len(START) + 1 + len(END) + 1} + CASE WHEN kept THEN 1 + length(base64(role::BLOB)) + length({_BODY}) ELSE length(role) + length(text) END AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars, true AS round_trip
FROM f GROUP BY conv_id
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5('mix|' || doc_id) AS ord FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (CASE (n - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM per),
lv AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT level AS open FROM lv WHERE cap > level * weight ORDER BY cap / weight, n LIMIT 1),
t AS (SELECT source, source_size, n, floor(budget)::BIGINT AS budget, CASE WHEN (SELECT open FROM o) IS NULL THEN cap ELSE least(cap, (SELECT open FROM o) * weight) END AS target FROM lv),
p AS (SELECT d.*, source_size, n, target, budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
s AS (SELECT row, n, target, budget, first + lap * source_size AS a, first + lap * source_size + size AS b, floor(target)::BIGINT AS due FROM p, (VALUES (0), (1)) l(lap) WHERE size > 0),
c AS (SELECT row, n, target, budget, list_sort(list_distinct([a, greatest(a, least(b, due)), greatest(a, least(b, due + 1)), b])) AS cuts FROM s),
u AS (SELECT row, n, target, budget, unnest(cuts[1 : len(cuts) - 1]) AS x, unnest(cuts[2 : len(cuts)]) AS y FROM c),
q AS (SELECT row, budget, y - x AS words, coalesce(sum(y - x) OVER (ORDER BY y / target, n, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM u),
k AS (SELECT row, sum(least(words, budget - position)) AS taken, min(position) AS position FROM q WHERE position < budget GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, position FROM p LEFT JOIN k USING (row)
"""

def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + ")[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"
_BLANK = "|".join(_any_case(w) for w in ("example", "changeme", "placeholder", "your")) + "[_-]"


def _places(kind: str, rank: int, pattern: str, group: int) -> str:
    """start, end (code points) and value of every match: from the lengths of the pieces between matches."""
    return f"""SELECT row, owner, '{kind}' AS kind, {rank} AS rank, start, start + len(hit) AS stop, value FROM (
      SELECT row, owner, hit, value, coalesce(sum(len(piece) + len(hit)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + len(piece) AS start FROM (
        SELECT row, owner, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(pieces[1 : len(hits)]) AS piece FROM (
          SELECT row, owner, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals, string_split_regex(text, '{pattern}') AS pieces FROM d) WHERE len(hits) > 0))"""


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT * FROM ({_places("assign", 0, _ASSIGN, 2)}) WHERE len(value) >= 6
  UNION ALL SELECT * FROM ({_places("access", 1, "AKIA[A-Z0-9]+", 0)}) WHERE len(value) >= 20
  UNION ALL SELECT * FROM ({_places("hex", 2, "[0-9a-f]+", 0)}) WHERE len(value) >= 24),
mixed AS (
  SELECT * FROM ({_places("owned", 3, "[A-Za-z0-9+/_=-]+", 0)}) m
  WHERE len(value) >= 20 AND regexp_matches(value, '[0-9]') AND lower(value) <> value AND upper(value) <> value
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = m.row AND b.start < m.stop AND b.stop > m.start)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM mixed),
bits AS (SELECT value, -sum(n / len * log2(n / len)) AS bits FROM (SELECT value, c, count(*)::DOUBLE AS n, len(value)::DOUBLE AS len FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM found)) GROUP BY value, c) GROUP BY value),
held AS (SELECT f.*, bits >= {LIVE_BITS} AND NOT regexp_matches(value, '[xX]{{4,}}|0{{6,}}|1234567') AND NOT regexp_matches(value, '{_BLANK}') AS live FROM found f JOIN bits USING (value)),
keep AS (SELECT * FROM held WHERE rank < 3 OR live),
owners AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doc_id::VARCHAR, '')) AS repos FROM keep JOIN d USING (row, owner) GROUP BY value),
told AS (SELECT k.*, owners >= {EXAMPLE_OWNERS} AND repos >= {EXAMPLE_REPOS} AS copied, NOT (owners >= {EXAMPLE_OWNERS} AND repos >= {EXAMPLE_REPOS}) AND live AS owned FROM keep k JOIN owners USING (value)),
sums AS (
  SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (owned) AS n_live, count(*) FILTER (copied) AS n_example
  FROM told WHERE rank < 3 OR owned GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN sums USING (row)
"""


def _template_rows() -> str:
    rows = []
    for t, (text, label, exact) in enumerate([(*p, True) for p in PHRASES] + [(*p, False) for p in NOTICES]):
        words, k = [w.decode() for w in license_words(text)], PHRASE_K if exact else NOTICE_K
        rows += [f"({t}, {_quoted(label)}, {str(exact).lower()}, {k}, {_quoted(' '.join(words[i : i + k]))}, {i}, {len(words) - k + 1})" for i in range(len(words) - k + 1)]
    return ", ".join(rows)


OP6 = f"""
WITH t(template, label, exact, k, gram, place, grams) AS (VALUES {_template_rows()}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
g AS (SELECT row, k, i - 1 AS pos, array_to_string(words[i : i + k - 1], ' ') AS gram FROM (SELECT row, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (VALUES ({PHRASE_K}), ({NOTICE_K})) x(k) WHERE len(words) >= k)),
votes AS (SELECT row, template, label, exact, grams, place, pos, pos - place AS diagonal FROM g JOIN t USING (k, gram)),
lines AS (SELECT row, template, label, exact, grams, diagonal FROM votes GROUP BY ALL),
marked AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER w > {SLACK}, true) THEN 1 ELSE 0 END AS new FROM lines WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)),
spanned AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
merged AS (
  SELECT s.row, s.template, s.label, s.exact, s.grams, s.span, count(DISTINCT v.place) AS covered, min(v.pos) AS start
  FROM spanned s JOIN votes v ON v.row = s.row AND v.template = s.template AND v.diagonal = s.diagonal GROUP BY ALL),
good AS (SELECT *, covered::DOUBLE / grams AS cover FROM merged WHERE CASE WHEN exact THEN covered = grams ELSE covered::DOUBLE / grams >= {COVER} END),
told AS (
  SELECT row, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN exact THEN 1.0 ELSE cover END)::DOUBLE AS score
  FROM good GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN told USING (row)
"""

_TRIPLE = " ".join(["xor(xor((l[i] * {0}) % 4294967296, (l[i + 1] * {1}) % 4294967296), (l[i + {{gap}}] * {2}) % 4294967296)".format(*MULTIPLIERS)])
_LIKE = "CASE WHEN {a}.fp = {b}.fp THEN 1.0 WHEN {a}.fp[1] = 's' OR {b}.fp[1] = 's' THEN 0.0 ELSE 1 - (least(%d, abs({a}.size - {b}.size)) + list_sum(list_transform(range(1, %d), lambda k: CASE WHEN abs({a}.levels[k] - {b}.levels[k]) = 3 THEN 6 ELSE abs({a}.levels[k] - {b}.levels[k]) END))) / %d.0 END" % (LENGTH_MOST, BUCKETS + 1, MOST)

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
e AS (SELECT doc_id, t, nxt, substr(t, 1, len(t) - len(t) // 2) || substr(nxt, 1, len(t) // 2) AS ed FROM n),
x AS (SELECT DISTINCT text, hex(encode(text)) AS h FROM (SELECT t AS text FROM e UNION ALL SELECT ed FROM e)),
b AS (SELECT text, h, list_transform(regexp_extract_all(h, '..'), lambda p: ((strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)::BIGINT) AS l FROM x),
g AS (
  SELECT text, {_TRIPLE.format(gap=2)} // 16777216 AS bucket FROM (SELECT text, l, unnest(range(1, len(l) - 1)) AS i FROM b WHERE len(l) >= 3)
  UNION ALL SELECT text, xor({_TRIPLE.format(gap=3)}, {TURN}) // 16777216 FROM (SELECT text, l, unnest(range(1, len(l) - 2)) AS i FROM b WHERE len(l) >= 4)),
c AS (SELECT text, bucket, count(*) AS n FROM g GROUP BY text, bucket),
f AS (SELECT b.text, k.bucket, coalesce(c.n, 0) AS n FROM (SELECT text FROM b WHERE len(l) >= 3) b CROSS JOIN (SELECT unnest(range(0, {BUCKETS})) AS bucket) k LEFT JOIN c ON c.text = b.text AND c.bucket = k.bucket),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n) AS place FROM f),
q AS (SELECT text, max(n) FILTER (place = {BUCKETS // 4}) AS q1, max(n) FILTER (place = {BUCKETS // 2}) AS q2, max(n) FILTER (place = {3 * BUCKETS // 4}) AS q3 FROM r GROUP BY text),
v AS (SELECT f.text, bucket, (n > q1)::INT + (n > q2)::INT + (n > q3)::INT AS level FROM f JOIN q USING (text)),
p AS (SELECT text, bucket // 4 AS slot, sum(level * CASE bucket % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 64 END)::INT AS byte FROM v GROUP BY 1, 2),
z AS (SELECT text, string_agg(lower(substr('0123456789ABCDEF', byte // 16 + 1, 1) || substr('0123456789ABCDEF', byte % 16 + 1, 1)), '' ORDER BY slot) AS digits FROM p GROUP BY text),
w AS (SELECT text, list(level ORDER BY bucket) AS levels FROM v GROUP BY text),
s AS (SELECT b.text, CASE WHEN len(l) >= 3 THEN least(255, round(8 * log2(len(l))))::INT END AS size, levels, digits, lower(h) AS h FROM b LEFT JOIN z USING (text) LEFT JOIN w USING (text)),
fp AS (SELECT text, size, levels, CASE WHEN size IS NULL THEN 's' || h ELSE 'q' || lower(substr('0123456789ABCDEF', size // 16 + 1, 1) || substr('0123456789ABCDEF', size % 16 + 1, 1)) || digits END AS fp FROM s)
SELECT e.doc_id, len(e.t)::BIGINT AS n_chars, sha256(e.ed) AS edited_sha256, o.fp AS fingerprint, m.fp AS edited_fingerprint,
  ({_LIKE.format(a="o", b="m")})::DOUBLE AS near_edited, ({_LIKE.format(a="o", b="y")})::DOUBLE AS near_next
FROM e JOIN fp o ON o.text = e.t JOIN fp m ON m.text = e.ed JOIN fp y ON y.text = e.nxt
"""

ORACLES = {"op1_ngram_join": OP1, "op2_secret_scan": OP2, "op3_topk_search": OP3, "op6_license_scan": OP6, "op7_chat_format": OP7, "op8_mixing": OP8, "op9_fingerprint": OP9}
