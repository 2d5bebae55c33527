"""DuckDB SQL for the operators whose whole result SQL can express, written straight from their definitions."""

from .licenses import PERCENT, PHRASES, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
FOLDED = f"translate(coalesce({{0}}, ''), '{UPPER}', '{LOWER}')"
ALNUM = r"regexp_extract_all(" + FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN.format(FOLDED.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS ra, b.rid AS rb, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS inter FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM common JOIN n na ON na.rid = ra JOIN n nb ON nb.rid = rb WHERE 100 * inter >= 85 * (na.n + nb.n - inter)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.root, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(least.root, d.doc_id), true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN least ON least.node = d.doc_id"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {PLAIN.format("text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS uppers, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters FROM d LEFT JOIN covered USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  word_chars < 2 * n_words OR word_chars > 16 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines * 10 > n_lines * 3 AND n_dup_lines >= 3) OR 2 * uppers > letters OR 2 * letters < word_chars AS rejected FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM j"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM.format("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {ALNUM.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
hits AS (SELECT rid, i, n, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {PLAIN.format("text")} AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM twice),
lost AS (SELECT rid, list(p) AS ps, count(*) AS n FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS rest FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)"""


def _rounds(n: int) -> str:
    """Assignment and new centroids, round after round; c0 are the first centroids, one row for each component."""
    out = []
    for r in range(n + 1):
        out.append(f"e{r} AS MATERIALIZED (SELECT rid, k, CAST(sum((q.x - c{r}.x) * (q.x - c{r}.x)) AS BIGINT) AS distance FROM q JOIN c{r} USING (d) GROUP BY rid, k)")
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, k, distance FROM e{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, k) = 1)")
        if r < n:
            out.append(f"m{r} AS (SELECT k, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM q JOIN a{r} USING (rid) GROUP BY k, d)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k, d))")
    return ",\n".join(out)


#: sums stay far below 2^53 here, so floor(sum / count) in doubles is exact
OP11 = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT rid, unnest(xs) AS x, unnest(range(1, 65)) AS d FROM v),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), xs) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, d, x FROM s JOIN q USING (rid) WHERE k < 40),
{_rounds(5)},
w AS (SELECT k, sum(distance) AS own FROM a5 GROUP BY k),
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS digest FROM c5 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(distance) FROM a5) AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a5 JOIN v USING (rid) JOIN w USING (k) JOIN h USING (k)"""

_values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)

OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {ALNUM.format("text")} AS w FROM documents),
p AS (SELECT label, {ALNUM.format("text")} AS ws FROM (VALUES {_values(PHRASES)}) v(text, label)),
stand AS (SELECT rid, label, unnest(list_filter(range(0, greatest(0, len(w) - len(ws) + 1)), lambda i: w[i + 1:i + len(ws)] = ws)) AS i FROM d, p),
base AS (SELECT rid, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM stand GROUP BY rid),
t AS (SELECT label, list_distinct(ws) AS s, CAST(pow(2, greatest(1, ceil(log2(len(ws))))) AS BIGINT) AS reach, ({PERCENT} * len(list_distinct(ws)) + 99) // 100 AS need FROM (SELECT label, {ALNUM.format("text")} AS ws FROM (VALUES {_values(TEMPLATES)}) v(label, text))),
b AS (SELECT rid, reach, list_distinct(w[i + 1:i + 2 * reach]) AS s FROM (SELECT rid, reach, w, unnest(range(0, len(w), reach)) AS i FROM d, (SELECT DISTINCT reach FROM t))),
hits AS (SELECT rid, label, len(list_intersect(t.s, b.s)) / CAST(len(t.s) AS DOUBLE) AS share FROM b JOIN t USING (reach) WHERE len(list_intersect(t.s, b.s)) >= need),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""

LETTERS = r"regexp_extract_all(" + FOLDED + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LETTERS.format("text")} AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, rid, term, count(*) AS n FROM (SELECT lang, source, rid, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS lang_n FROM n GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS all_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM n JOIN kept USING (lang, term) GROUP BY lang, source, term),
own AS (SELECT lang, source, sum(n) AS own_n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n,
  1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(own_n, 0) + 5 * v)::HUGEINT AS p,
  1 + (1000000000 * (lang_n + 5)::HUGEINT) // (all_n + 5 * v)::HUGEINT AS q
  FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM parts
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50"""
