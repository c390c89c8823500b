"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from shardframe.llm.license_scan import LEAST_SHARE, PHRASES, TEXTS

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"

# Every 50-byte string by its place, in hexadecimal; the smallest document of each; bytes that a later document loses.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM s JOIN m USING (g) WHERE least < doc_id),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (
  SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS before FROM hit)) GROUP BY doc_id, r),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, h, n_spans, n_removed,
  CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(len(starts) + 1),
    lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE stops[i] END + 1,
      2 * (CASE WHEN i = len(starts) THEN len(h) // 2 ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE stops[i] END))), '') END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM kept
"""


def _values(rows: list[tuple]) -> str:
    quoted = [", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) for row in rows]
    return ", ".join(f"({q})" for q in quoted)


def op2_sql() -> str:
    """Words join the words of phrases, texts and key phrases; equal offsets make up a match."""
    templates = [(label, p, True) for p, label in PHRASES] + [(label, t, False) for label, t, _ in TEXTS]
    words, keys = [], []
    for t, (label, text, base) in enumerate(templates):
        parts = text.split()
        words += [(t, k, w, label, base, len(parts)) for k, w in enumerate(parts)]
    for t, (_, _, phrases) in enumerate(TEXTS, start=len(PHRASES)):
        for j, phrase in enumerate(phrases):
            parts = phrase.split()
            keys += [(t, j, k, w, len(parts)) for k, w in enumerate(parts)]
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
t(t, off, word, label, base, n) AS (VALUES {_values(words)}),
k(t, j, off, word, n) AS (VALUES {_values(keys)}),
a AS (SELECT doc_id, t, label, base, n, place, c / n AS share FROM (SELECT w.doc_id, t.t, label, base, t.n, pos - off AS place, count(*) AS c FROM w JOIN t USING (word) GROUP BY 1, 2, 3, 4, 5, 6)),
c AS (SELECT a.* FROM a JOIN d USING (doc_id) WHERE share >= CASE WHEN base THEN 1.0 ELSE {LEAST_SHARE} END AND place >= 0 AND place + n <= len(ws)),
ka AS (SELECT doc_id, t, j, n, place FROM (SELECT doc_id, t, j, k.n, pos - off AS place, count(*) AS c FROM w JOIN k USING (word) GROUP BY 1, 2, 3, 4, 5) WHERE c = n),
held AS (SELECT c.doc_id, c.t, c.place, count(DISTINCT j) AS held FROM c JOIN ka ON ka.doc_id = c.doc_id AND ka.t = c.t AND ka.place >= c.place AND ka.place + ka.n <= c.place + c.n GROUP BY 1, 2, 3),
wanted AS (SELECT t, count(DISTINCT j) AS wanted FROM k GROUP BY t),
good AS (SELECT c.* FROM c LEFT JOIN held USING (doc_id, t, place) LEFT JOIN wanted USING (t) WHERE base OR held = wanted),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM good GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN found USING (doc_id)
"""


OP5_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, """
    + SPACED
    + r""") AS ws FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d) WHERE regexp_matches(line, """
    + SPACED
    + r""") GROUP BY doc_id),
grams AS (SELECT doc_id, place, array_to_string(ws[place:place + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS place FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, place FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT place + o) AS n FROM again, (SELECT unnest(range(8)) AS o) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
    (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS letters,
    len(list_filter(ws, lambda v: regexp_matches(v, '[A-Za-z]|[^\x00-\x7F]'))) AS plain,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutters
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * up > letters OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * plain < n_words OR 5 * stutters > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""
)

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT doc_id, len(any_value(s))::BIGINT AS n_shingles, min(other) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, v.r, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM s) WHERE rank <= 5
"""

OP12_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all("""
    + LOWER
    + r""", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
gt AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT gt.lang, gt.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gt.total + v) AS p,
    1 + (1000000000 * (kept.n + 1)) // (v.total + v) AS ql
  FROM gt JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - ql) * (p - ql)) // ql)::BIGINT AS value FROM p WHERE n > 0 AND p > ql)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
)

OP13_SQL = (
    r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex("""
    + LOWER
    + r""", '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, array_to_string(ws[1 + o:2 + o], ' ') AS phrase, max(a) AS longest FROM c, (SELECT unnest([0, 1]) AS o) WHERE k = 3 GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON c.k = 2 AND longer.lang = c.lang AND longer.phrase = c.phrase WHERE longest IS NULL OR 100 * longest < 50 * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""
)
