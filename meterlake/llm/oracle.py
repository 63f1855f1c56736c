"""The operators' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_URL = """
WITH parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(host_rule, path_rule, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
    SELECT parts.*, host_rule || path_rule AS fit, rules.verdict AS said
    FROM parts LEFT JOIN rules ON (host = host_rule OR ends_with(host, '.' || host_rule))
        AND starts_with(path, path_rule)
)
SELECT page_id, host, path, arg_max(fit, length(fit)) AS rule,
    coalesce(arg_max(said, length(fit)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(s, t) AS (
    SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s
), low AS (SELECT s, min(t) AS t FROM reach GROUP BY s),
direct AS (SELECT s, count(*) AS n FROM links GROUP BY s)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(t, vec_id)) AS component_id,
    vec_id <= coalesce(t, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.s LEFT JOIN direct ON vec_id = direct.s
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN coalesce(len(words), 0) = 0 THEN []::VARCHAR[]
        WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1),
            lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s
    FROM w
), classes AS (
    SELECT min(doc_id) AS id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets)
    WHERE len(s) > 0 GROUP BY s
), grams AS (SELECT id, n, unnest(s) AS g FROM classes),
links AS (
    SELECT a.id AS s, b.id AS t FROM grams a JOIN grams b
        ON a.g = b.g AND a.id <> b.id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
    GROUP BY a.id, b.id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(s, t) AS (
    SELECT s, t FROM links UNION SELECT r.s, l.t FROM reach r JOIN links l ON r.t = l.s
), low AS (SELECT s, min(t) AS t FROM reach GROUP BY s)
SELECT doc_id, len(sets.s) AS n_shingles,
    least(coalesce(id, doc_id), coalesce(low.t, id, doc_id)) AS component_id
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s
LEFT JOIN low ON classes.id = low.s
"""

_SUFFIX = """
WITH d AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), h AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
win AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
    FROM h, unnest(range(0, greatest(n - 49, 0))) AS t(i)
), hit AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win)
    WHERE doc_id > f
), marked AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50
            THEN 0 ELSE 1 END AS new FROM hit)
), spans AS (
    SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM marked GROUP BY doc_id, g
), pieces AS (
    SELECT doc_id, b, substr(h, 2 * p + 1, 2 * (b - p)) AS piece FROM (
        SELECT doc_id, h, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p FROM (
            SELECT doc_id, h, b, e FROM spans JOIN h USING (doc_id)
            UNION ALL SELECT doc_id, h, n, n FROM h))
), kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY b) AS k FROM pieces GROUP BY doc_id),
cut AS (SELECT doc_id, sum(e - b) AS r, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed,
    coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

_SUBSTRING = r"""
WITH w AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
    FROM documents
), win AS (
    SELECT doc_id, i, array_to_string(words[i + 1:i + 20], ' ') AS s
    FROM w, unnest(range(0, greatest(len(words) - 19, 0))) AS t(i)
), hit AS (
    SELECT doc_id, i FROM (SELECT doc_id, i,
        row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, 20)) AS t(k)
), each AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM w
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
    FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
grams AS (
    SELECT lang, size, array_to_string(words[i + 1:i + size], ' ') AS phrase
    FROM w, unnest([1, 2, 3, 4, 5]) AS s(size), unnest(range(0, greatest(len(words) - size + 1, 0))) AS t(i)
), f AS (
    SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS words
    FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.size, c.f AS a, k, l.f AS l, r.f AS r, n,
        (1000 * c.f::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
    FROM f c, unnest(range(1, c.size)) AS t(k), totals, f l, f r
    WHERE c.size > 1 AND totals.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
        AND l.phrase = array_to_string(c.words[1:k], ' ') AND r.phrase = array_to_string(c.words[k + 1:], ' ')
), low AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts)
    WHERE nth = 1
), kept AS (
    SELECT * FROM low WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.lang = low.lang AND f.size > low.size AND f.f >= low.a
            AND contains(' ' || f.phrase || ' ', ' ' || low.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
    phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

_LEXICAL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), sizes AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n) AS words FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY 1, 2),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf
        + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
    doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

_VECTORS = """
WITH v AS (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score
FROM pairs QUALIFY rank <= 5
"""

ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": _EMBEDDINGS,
    "op5_url_filters": _URL,
    "op6_ngram_jaccard_join": _JACCARD,
    "op8_suffix_array_dedup": _SUFFIX,
    "op10_substring_dedup": _SUBSTRING,
    "op11_phrase_mining": _PHRASES,
    "op12_lexical_search": _LEXICAL,
    "op13_vector_search": _VECTORS,
}
