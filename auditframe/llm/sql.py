"""SQL twins, written for an engine with views of the given tables."""

#: Every pair of documents that share a shingle is compared, so this is for small tables only.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
                                   ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
        FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

EXACT_DEDUP = """
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: As above; three words and 0.9.
LINKED_SETS = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
        FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common >= 90 * (p.n + q.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

FILTER_INTERACTIONS = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                  CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                  CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
    FROM texts LEFT JOIN marks USING (doc_id)),
masks AS MATERIALIZED (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
grown AS (
    SELECT letter AS filter_order FROM letters
    UNION ALL
    SELECT filter_order || letter FROM grown JOIN letters ON NOT contains(filter_order, letter)),
orders AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
           FROM grown CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5),
counted AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN translate(fails, earlier || letter, '') = fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks CROSS JOIN orders GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""

LEXICAL_SEARCH = r"""
WITH lowered AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT doc, doc_id, terms, len(terms)::BIGINT AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM docs),
postings AS MATERIALIZED (
    SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
asked AS MATERIALIZED (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
weights AS MATERIALIZED (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings CROSS JOIN totals GROUP BY term),
scores AS (
    SELECT item_id, doc, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) CROSS JOIN totals GROUP BY item_id, doc)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
