"""DuckDB statements for the queries that SQL can express."""

MIXING = r"""
WITH docs AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)
                AS BIGINT) AS h
    FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY k),
weighted AS (
    SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS weight FROM sources),
-- sources reach their cap in the order of size to weight; the first rate that caps no further source holds
ranked AS (
    SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio,
           sum(source_size) OVER () AS total,
           sum(weight) OVER () AS weights
    FROM weighted),
steps AS (
    SELECT ratio, any_value(total) AS total, any_value(weights) AS weights,
           sum(2 * source_size) AS caps, sum(weight) AS capped FROM ranked GROUP BY ratio),
running AS (
    SELECT ratio, total, weights,
           coalesce(sum(caps) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
           coalesce(sum(capped) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
    FROM steps),
rates AS (
    SELECT ratio, CAST(1.5 * total - held AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS rate FROM running),
rate AS (SELECT rate FROM rates WHERE rate <= 2 * ratio ORDER BY ratio LIMIT 1),
wanted AS (
    SELECT k, source_size, least(CAST(2 * source_size AS DOUBLE), rate * weight) AS target
    FROM weighted CROSS JOIN rate),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats
    FROM wanted),
groups AS (
    SELECT k, h, CAST(sum(size) AS BIGINT) AS words, count(*) AS alike FROM docs GROUP BY k, h),
placed AS (
    SELECT *, CAST(sum(words) OVER (PARTITION BY k ORDER BY h) - words AS BIGINT) AS before FROM groups)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(p.repeats * d.size + CASE
           WHEN g.before + g.words <= p.target - p.repeats * p.source_size THEN d.size
           WHEN g.before > p.target - p.repeats * p.source_size THEN 0
           WHEN g.alike = 1 THEN CASE
               WHEN 2 * (p.target - p.repeats * p.source_size - g.before) >= g.words THEN d.size ELSE 0 END
           -- alike rows share what is left, to the word
           ELSE floor((d.nth * d.size + d.size) * (p.target - p.repeats * p.source_size - g.before) / g.words)
              - floor(d.nth * d.size * (p.target - p.repeats * p.source_size - g.before) / g.words)
       END AS BIGINT) AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY k, h) - 1 AS nth FROM docs) d
JOIN plan p USING (k) JOIN placed g ON g.k = d.k AND g.h = d.h
"""

DECONTAMINATION = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS part
    FROM sized, unnest(range(1, len(w) - size + 2)) AS t(i)),
sizes AS (SELECT DISTINCT size FROM sized),
doc_windows AS (
    SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS part
    FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
met AS (SELECT r, i, size, item_id FROM doc_windows JOIN item_windows USING (size, part)),
hit AS (
    SELECT r, count(DISTINCT place) AS n FROM met, unnest(range(i, i + size)) AS t(place) GROUP BY r),
found AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(f.listed, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN found f USING (r)
"""

EXACT_TOPK = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
    SELECT q.r AS query_row, q.vec_id AS query_id, c.r AS cand_row, c.vec_id AS vec_id,
           CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, least(len(q.v), len(c.v)) + 1)]) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.r <> c.r AND q.vec_id % 50 = 0),
ranked AS (
    SELECT *, CAST(row_number() OVER (
        PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST, cand_row) AS INT) AS rank
    FROM scores)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM ranked WHERE rank <= 5
"""

# Rows meet the rows of equal sets through one set each; links are closed by repetition.
JACCARD = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingled AS (
    SELECT r, doc_id, list_sort(list_distinct(CASE
        WHEN len(w) >= 3 THEN [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM docs),
sets AS (
    SELECT row_number() OVER () AS k, s, len(s) AS n, min(doc_id) AS least FROM shingled WHERE len(s) > 0 GROUP BY s),
flat AS (SELECT k, n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.k AS a, b.k AS b
    FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.k <> b.k AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.k, b.k, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
    SELECT k, k AS other FROM sets
    UNION
    SELECT reached.k, links.b FROM reached JOIN links ON links.a = reached.other),
component AS (SELECT reached.k, min(sets.least) AS least FROM reached JOIN sets ON sets.k = reached.other GROUP BY reached.k)
SELECT shingled.doc_id, CAST(len(shingled.s) AS BIGINT) AS n_shingles, coalesce(component.least, shingled.doc_id) AS component_id
FROM shingled LEFT JOIN sets ON sets.s = shingled.s LEFT JOIN component ON component.k = sets.k
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": EXACT_TOPK,
    "op7_jaccard_join": JACCARD,
    "op2_mixing": MIXING, "op13_decontamination": DECONTAMINATION,
}
