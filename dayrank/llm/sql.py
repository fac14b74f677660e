"""What the corpus queries compute, as SQL for DuckDB, where SQL can say it."""

from __future__ import annotations

from dayrank.llm import centroids, quality, spelling
from dayrank.llm.licenses import LOWER, TEMPLATES, THRESHOLD, UPPER, explained_by, template_bigrams


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


_VALUES = ",\n    ".join(f"({_text(name)}, {_text(text)})" for name, text in TEMPLATES.items())

_RULES = ",\n    ".join(
    f"({_text(s)}, {_text(t)}, {most!r}::DOUBLE, {lag!r}::DOUBLE)"
    for s, t, most, lag in explained_by({n: template_bigrams(x) for n, x in sorted(TEMPLATES.items())}, THRESHOLD)
)

OP4 = f"""
WITH templates(template, body) AS (VALUES
    {_VALUES}),
units AS (
    SELECT r, doc_id, unnest(list_distinct(list_concat(
        string_split(t, chr(10)), regexp_split_to_array(t, '\\n[ \\t]*\\n'), [t]))) AS body
    FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)),
numbered AS (SELECT row_number() OVER () AS k, r, body FROM units),
names AS (SELECT row_number() OVER (ORDER BY template) AS k, template, body FROM templates),
words AS (
    SELECT 'u' AS kind, k, regexp_extract_all({_lowered("body")}, '[a-z0-9]+') AS w FROM numbered
    UNION ALL SELECT 't', k, regexp_extract_all({_lowered("body")}, '[a-z0-9]+') FROM names),
grams AS (
    SELECT DISTINCT kind, k, w[i] || ' ' || w[i + 1] AS g
    FROM (SELECT kind, k, w, unnest(range(1, len(w))) AS i FROM words)),
sizes AS (SELECT kind, k, count(*) AS n FROM grams GROUP BY ALL),
shared AS (
    SELECT u.k AS u, t.k AS t, count(*) AS n FROM grams u JOIN grams t ON u.g = t.g
    WHERE u.kind = 'u' AND t.kind = 't' GROUP BY ALL),
found AS (
    SELECT numbered.r, names.template, max(2.0::DOUBLE * shared.n / (a.n + b.n)) AS dice
    FROM shared
    JOIN sizes a ON a.kind = 'u' AND a.k = shared.u
    JOIN sizes b ON b.kind = 't' AND b.k = shared.t
    JOIN numbered ON numbered.k = shared.u
    JOIN names ON names.k = shared.t
    GROUP BY ALL HAVING max(2.0::DOUBLE * shared.n / (a.n + b.n)) >= {THRESHOLD}),
rules(s, t, most, lag) AS (VALUES
    {_RULES}),
kept AS (
    SELECT * FROM found a WHERE NOT EXISTS (
        SELECT 1 FROM rules JOIN found b ON b.template = rules.t
        WHERE b.r = a.r AND rules.s = a.template AND a.dice <= most AND b.dice - a.dice > lag)),
per_row AS (
    SELECT r, count(*) AS n, string_agg(template, ',' ORDER BY template) AS licenses, max(dice) AS best
    FROM kept GROUP BY r)
SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS n_licenses, coalesce(p.licenses, '') AS licenses,
    coalesce(p.best, 0)::DOUBLE AS best_dice
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN per_row p USING (r)
"""
_WORDS = r"regexp_extract_all({}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

OP6 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_lowered("text"))} AS w FROM documents),
items AS (
    SELECT item_id::VARCHAR AS item, {_WORDS.format(_lowered("text"))} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT r, n, i, item FROM places JOIN windows USING (n, g)),
hit AS (
    SELECT r, count(DISTINCT i + k) AS n_hit
    FROM (SELECT r, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT r, n, i FROM found)) GROUP BY r),
named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_REACHED = """
reach(d, c) AS (
    SELECT id, id FROM nodes
    UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.d),
component AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
"""

OP8 = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM documents),
{_REACHED}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN component ON d = doc_id
"""

OP9 = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x for x in embedding if x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT vec_id AS id FROM embeddings),
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
{_REACHED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings LEFT JOIN degree ON a = vec_id JOIN component ON d = vec_id
"""

OP10 = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END
        AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

#: The CRC-32 of ``bytes`` (a list of integers) with the table ``tab``.
_CRC = "xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"

OP11 = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS tab
    FROM range(256) t(i)),
runs AS (
    SELECT d, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '{spelling.RUN}')) AS run
        FROM documents)),
counted_runs AS (
    SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL),
hashed AS (
    SELECT run, n, {_CRC} AS h
    FROM (SELECT run, n, flatten([CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END
            for u in [unicode(x)::BIGINT for x in string_split(d || ':' || run, '')]]) AS bytes
        FROM counted_runs), crc_table),
edited AS (
    SELECT CASE WHEN h % {spelling.SLIP} = 0
        THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
        ELSE run END AS word, n
    FROM hashed),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {spelling.LEAST_LETTERS}
    GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
replaced AS (SELECT word, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS g FROM places),
shorter AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM places),
near AS (
    SELECT a.word, b.word AS other FROM replaced a JOIN replaced b ON a.g = b.g AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.g
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.g),
ranked AS (
    SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS place
    FROM near JOIN words w ON w.word = other),
forms AS MATERIALIZED (
    SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
        CASE WHEN ranked.n >= {spelling.RATIO} * words.n THEN other END AS form,
        CASE WHEN ranked.n >= {spelling.RATIO} * words.n THEN ranked.n END AS form_n
    FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
up(word, top) AS (
    SELECT word, word FROM forms
    UNION SELECT up.word, forms.form FROM up JOIN forms ON forms.word = up.top WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, up.top AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN up ON up.word = f.word JOIN forms last ON last.word = up.top AND last.form IS NULL
"""

_GAP = f"list_sum(list_transform(range(1, {centroids.DIMENSIONS + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"


def _nearest(at: int) -> str:
    return f"""
a{at} AS MATERIALIZED (
    SELECT r, (best % 64)::INTEGER AS cluster, (best // 64)::BIGINT AS distance
    FROM (SELECT r, min({_GAP}::HUGEINT * 64 + k) AS best FROM kept, c{at} GROUP BY r))"""


def _moved(at: int) -> str:
    return f"""
s{at} AS (
    SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*) AS n
    FROM (SELECT cluster, x, unnest(range(1, {centroids.DIMENSIONS + 1})) AS i
        FROM a{at - 1} JOIN kept USING (r)) GROUP BY cluster, i),
c{at} AS MATERIALIZED (
    SELECT k, coalesce(moved, c) AS c FROM c{at - 1} LEFT JOIN (
        SELECT cluster AS k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS moved
        FROM s{at} GROUP BY cluster) USING (k))"""


OP12 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [floor(256 * v::DOUBLE)::BIGINT for v in embedding] AS x
    FROM embeddings
    WHERE len(embedding) = {centroids.DIMENSIONS}
        AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
    FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept)
    ORDER BY h, x LIMIT {centroids.K}),
{",".join(_nearest(at) + "," + _moved(at + 1) for at in range(centroids.ROUNDS))},
{_nearest(centroids.ROUNDS)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS total FROM a{centroids.ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, distance, total AS cluster_inertia,
    (SELECT sum(distance)::BIGINT FROM a{centroids.ROUNDS}) AS inertia,
    sha256(array_to_string([v::VARCHAR for v in c], ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN kept USING (r) JOIN sums USING (cluster) JOIN c{centroids.ROUNDS} ON k = cluster
"""

_CLASSES = [*quality.CLASSES.values(), quality.SPACE]


def _class_columns(text: str) -> str:
    """Characters of each class: what the text loses as the classes are taken out in their order."""
    columns, left = [], text
    for at, pattern in enumerate(_CLASSES):
        rest = f"regexp_replace({left}, {_text(pattern)}, '', 'g')"
        columns.append(f"(length({left}) - length({rest}))::BIGINT AS k{at}")
        left = rest
    return ", ".join([*columns, f"length({left})::BIGINT AS k{len(_CLASSES)}"])


#: The classes without the characters between words.
_KEPT = [at for at in range(len(_CLASSES) + 1) if at != len(_CLASSES) - 1]


def _half(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) / 2 ELSE 0 END"


def _bin(p: str, q: str) -> str:
    return f"({_half(p, q)} + {_half(q, p)})"


_SHARES = ", ".join(f"k{at}::DOUBLE / ({' + '.join(f'k{b}' for b in _KEPT)}) AS k{at}" for at in _KEPT)
_DOC_SHARES = ", ".join(f"c.k{at}::DOUBLE / word_chars AS k{at}" for at in _KEPT)
_CLASS_SUM = " + ".join(_bin(f"s.k{at}", f"x.k{at}") for at in _KEPT)
_WORDS_OF = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP13 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
        {_WORDS_OF.format("coalesce(text, '')")} AS w
    FROM documents),
classes AS (SELECT r, lang, {_class_columns("t")} FROM docs),
sized AS (
    SELECT r, doc_id, docs.lang, t, w, len(w)::BIGINT AS n_words,
        (length(t) - k{len(_CLASSES) - 1})::BIGINT AS word_chars
    FROM docs JOIN classes USING (r)),
each AS (SELECT r, lang, unnest(w) AS word FROM docs),
counted AS (SELECT lang, word, count(*) AS n FROM each GROUP BY ALL),
langs AS (
    SELECT lang, sum(n) AS total, {", ".join(f"sum(k{at})::BIGINT AS k{at}" for at in _KEPT)}
    FROM (SELECT lang, {_class_columns("word")}, 1 AS n FROM each) GROUP BY lang),
class_refs AS (SELECT lang, {_SHARES} FROM langs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted),
refs AS (
    SELECT lang, word, n::DOUBLE / total AS q FROM ranked JOIN langs USING (lang)
    WHERE place <= {quality.COMMON}),
hits AS (
    SELECT r, e.lang, word, count(*)::DOUBLE AS n FROM each e JOIN refs USING (lang, word) GROUP BY ALL),
terms AS (
    SELECT r, sum({_bin("p", "q")}) AS each_bin, sum(q) AS present, sum(p) AS used
    FROM (SELECT h.r, h.n / d.n_words AS p, refs.q FROM hits h JOIN refs USING (lang, word) JOIN sized d USING (r))
    GROUP BY r),
known AS (SELECT lang, sum(q) AS q FROM refs GROUP BY lang),
word_distances AS (
    SELECT r, sqrt(greatest(round(coalesce(each_bin, 0) + greatest(known.q - coalesce(present, 0), 0) / 2
        + {_bin("(1 - coalesce(used, 0))", "greatest(1 - known.q, 0)")}, 12), 0)) AS word_distance
    FROM sized LEFT JOIN terms USING (r) JOIN known USING (lang)
    WHERE n_words >= {quality.MIN_WORDS}),
class_distances AS (
    SELECT s.r, sqrt(greatest(round({_CLASS_SUM}, 12), 0)) AS class_distance
    FROM (SELECT c.r, c.lang, {_DOC_SHARES} FROM classes c JOIN sized USING (r)
        WHERE word_chars >= {quality.MIN_CHARS}) s
    JOIN class_refs x USING (lang)),
windows AS (
    SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
repeated AS (
    SELECT r, count(DISTINCT i + k) AS n
    FROM (SELECT r, i, unnest([0, 1, 2]) AS k FROM windows
        JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g))
    GROUP BY r),
lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
    SELECT doc_id, n_words, word_chars,
        (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
        class_distance, word_distance
    FROM sized LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
        LEFT JOIN class_distances USING (r) LEFT JOIN word_distances USING (r)),
judged AS (
    SELECT *, n_words < {quality.LEAST_WORDS}
        OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
    FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_distance, 0) <= {quality.MOST_CLASS}
        AND coalesce(word_distance, 0) <= {quality.MOST_WORD} AS kept,
    round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged
"""

SQL = {
    "op4_licenses": OP4,
    "op6_decontaminate": OP6,
    "op8_near_duplicates": OP8,
    "op9_embedding_near_duplicates": OP9,
    "op10_warc": OP10,
    "op11_spelling": OP11,
    "op12_centroids": OP12,
    "op13_quality": OP13,
}
