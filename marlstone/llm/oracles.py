"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from marlstone.llm.spotsigs import ANCHORS

#: Strips ASCII white space at both ends and lower-cases A-Z.
_KEY = "translate(trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY.format(x="line")} AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < top, false) AS dropped FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS10 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
b AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
b_windows AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM b_windows),
d_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM d_windows JOIN b_windows USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
linked AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""



def _op11(rounds: int = 6) -> str:
    """Codebooks by rounds of full comparison: a statement for each assignment and each update."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, x, b.d AS d, b.e AS entry FROM (
    SELECT vec_id, label, part, x, min({{'d': list_sum(list_transform(x, lambda v, i: (v - c[i]) * (v - c[i]))), 'e': entry}}) AS b
    FROM parts JOIN c{r} USING (part) GROUP BY ALL))"""
    update = """
m{r} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n
    FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM a{r}) GROUP BY part, entry, pos)
  GROUP BY part, entry),
c{n} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))"""
    steps = [assign.format(r=r) + ("," + update.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, list_transform(v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)], lambda x: CAST(x AS HUGEINT)) AS x FROM k, range(8) t(part)),
c0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16)),{",".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
labels_of AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded JOIN labels_of ON coded.label IS NOT DISTINCT FROM labels_of.label, books
"""


OP11 = _op11()

OP12 = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM grams WHERE k >= 2 AND f >= 100),
cuts AS (
  SELECT c.lang, c.g, c.k, c.a, n, j, x.f AS l, y.f AS r, (1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN totals USING (lang)
  JOIN grams x ON x.lang = c.lang AND x.k = j AND x.g = array_to_string(w[1:j], ' ')
  JOIN grams y ON y.lang = c.lang AND y.k = c.k - j AND y.g = array_to_string(w[j + 1:c.k], ' ')),
best AS (SELECT lang, k, g, a, n, min({'score': score, 'j': j, 'l': l, 'r': r}) AS b FROM cuts GROUP BY ALL),
inner_of AS (
  SELECT lang, m AS k, array_to_string(w[i:i + m - 1], ' ') AS g, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 5) t(m) WHERE m < k) GROUP BY ALL),
ranked AS (
  SELECT lang, g AS phrase, a, n, b.l AS l, b.r AS r, CAST(b.score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, g) AS rank
  FROM best LEFT JOIN inner_of USING (lang, k, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _op13(anchors: tuple[str, ...]) -> str:
    named = ", ".join(f"'{a}'" for a in anchors)
    low = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_transform(regexp_extract_all({low}, '\\p{{Han}}|\\p{{Hiragana}}|\\p{{Katakana}}|[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: CASE WHEN w IN ({named}) THEN chr(1) || w ELSE w END)"
    glued = f"regexp_replace(array_to_string({words}, ' '), chr(1) || '([^ ]+) ', chr(1) || '\\1' || chr(2), 'g')"
    bare = lambda t: f"split_part({t}, chr(2), -1)"
    near = lambda a, b: f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following FROM documents),
e AS (SELECT *, left(t, n_chars - n_chars // 3) || left(following, n_chars // 3) AS edited FROM d),
texts AS (SELECT doc_id, unnest(['own', 'edited', 'next']) AS which, unnest([t, edited, following]) AS x FROM e),
tokens AS (SELECT doc_id, which, x, list_filter(string_split({glued}, ' '), lambda s: s <> '' AND NOT starts_with({bare('s')}, chr(1))) AS t FROM texts),
chains AS (SELECT doc_id, which, x, list_transform(t, lambda s, i: concat_ws(' ', s, {bare('t[i + 1]')}, {bare('t[i + 2]')})) AS c FROM tokens),
kept AS (SELECT doc_id, which, CASE WHEN len(list_filter(c, lambda s: starts_with(s, chr(1)))) > 0 THEN list_filter(c, lambda s: starts_with(s, chr(1))) WHEN len(c) > 0 THEN c ELSE [x] END AS k FROM chains),
sets AS (SELECT doc_id, which, list_sort(list_distinct(list_transform(k, lambda s: md5(s)[1:8]))) AS s FROM kept),
wide AS MATERIALIZED (
  SELECT doc_id, any_value(s) FILTER (WHERE which = 'own') AS a, any_value(s) FILTER (WHERE which = 'edited') AS b, any_value(s) FILTER (WHERE which = 'next') AS c FROM sets GROUP BY doc_id)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       {near('a', 'b')} AS near_edited, {near('a', 'c')} AS near_next
FROM e JOIN wide USING (doc_id)
"""


OP13 = _op13(ANCHORS)

ORACLES: dict[str, str] = {"op3_group_jaccard_join": OP3, "op7_warc_index": OP7, "op9_line_dedup": OP9, "op10_fm_decontamination": OP10, "op11_annular_codes": OP11, "op12_pair_naming_collocations": OP12, "op13_spotsigs": OP13}
