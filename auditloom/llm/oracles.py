"""Expected results in SQL (DuckDB) of the corpus operators that SQL can express, by brute force."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"
N_WORDS = f"len({WORDS})"

#: All pairs that share a shingle, counted on full sets; components by reachability.
NEAR_DEDUP = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s
  FROM worded WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * p.common >= 80 * (m.n + n.n - p.common)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), named AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN named c ON c.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

_PHRASES = (
    "lorem ipsum|javascript|cookie|privacy policy|terms of use|terms of service|"
    "all rights reserved|click here|subscribe to our newsletter|sign up for|log in to"
)


def _count(text: str, characters: str) -> str:
    return f"length(regexp_replace({text}, '[^{characters}]', '', 'g'))"


QUALITY = rf"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("text")} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS h
  FROM worded WHERE len(w) >= 8
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, pos, line, {N_WORDS.format("line")} AS n, regexp_replace(line, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', '', 'g') AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM worded)
), judged AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
    {_count("body", "|›»•·>")} >= greatest(2, 0.2 * n)
    OR (NOT regexp_matches(body, '[.!?…:;"''”’»)\]。！？]$') AND NOT contains(body, '. '))
    OR 4 * {_count("body", "#*$%&|<>")} >= greatest(4, n)
    OR 2 * {_count("body", "!?")} > greatest(3, n)
    OR regexp_matches(lower(body), '{_PHRASES}') AS failed
  FROM lines WHERE n > 0
), totals AS (
  SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (failed), 0) AS n_lost_words
  FROM judged GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    {_count("text", "#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed,
    coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words
  FROM worded LEFT JOIN repeated r USING (doc_id) LEFT JOIN totals USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 2 * n_lost_words <= n_words AS kept,
  n_failed_lines::BIGINT AS n_failed_lines, n_lost_words::BIGINT AS n_lost_words
FROM measured
"""

#: Targets: sources stop in the order of ceiling over weight; the first that need not stop fixes the level.
MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, {N_WORDS.format("text")}::BIGINT AS size, md5('mix' || doc_id::VARCHAR) AS place FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM totals),
weighed AS (SELECT *, [3, 1, 2][(source_rank - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS ceiling FROM ranked),
steps AS (
  SELECT *, row_number() OVER (ORDER BY ceiling / weight, source_rank) AS step, sum(source_size) OVER () AS words,
    coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY ceiling / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM weighed
), level AS (
  SELECT arg_min((1.5::DOUBLE * words - held) / free, step) AS level FROM steps WHERE ceiling >= (1.5::DOUBLE * words - held) / free * weight
), targets AS (SELECT source, source_rank, source_size, least(ceiling, level * weight) AS target FROM weighed, level),
queued AS (
  SELECT doc_id, size, place, t.source_rank, t.source_size, t.target,
    sum(size) OVER (PARTITION BY t.source_rank ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS words_to
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, CASE WHEN target > 0 THEN (words_to + turn * source_size)::DOUBLE / target ELSE 0 END AS finish
  FROM queued, (VALUES (0), (1)) v(turn)
), placed AS (
  SELECT doc_id, row_number() OVER served AS pos, sum(size) OVER served AS served_to
  FROM copies WINDOW served AS (ORDER BY finish, source_rank, turn, place, doc_id ROWS UNBOUNDED PRECEDING)
), cut AS (SELECT max(pos) AS pos FROM placed WHERE served_to <= (SELECT sum(target) FROM targets) + 0.000001)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken
FROM queued LEFT JOIN (SELECT doc_id, count(*) AS n FROM placed WHERE pos <= (SELECT pos FROM cut) GROUP BY doc_id) USING (doc_id)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line FROM documents
), windows AS (
  SELECT doc_id, p AS p0, lead(p, 2) OVER w AS p1, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p0, p1 FROM windows WHERE p1 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p0) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(p0, p1 + 1)) AS p FROM later),
cleaned AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN c.n_removed > 0 THEN c.text ELSE d.text END AS text,
  coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cleaned c ON c.doc_id = d.doc_id
"""

#: Every document against every item, term by term.
RANKED_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES = {
    "op1_minhash_near_dedup": NEAR_DEDUP,
    "op3_quality_rules": QUALITY,
    "op7_mixing": MIXING,
    "op8_line_dedup": LINE_DEDUP,
    "op13_ranked_search": RANKED_SEARCH,
}
