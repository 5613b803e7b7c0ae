"""DuckDB statements that the queries must equal, where SQL can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RUNS = r"[^\x20\x09-\x0D]+"

TOP_K = """
    WITH v AS (
        SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings WHERE embedding IS NOT NULL
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ),
    ranked AS (
        SELECT query_id, vec_id, score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

NGRAM_JOIN = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _RUNS)} AS w FROM documents),
    grams AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g
        FROM w
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
        FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * i >= 90 * (x.n + y.n - i)
    ),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
        SELECT a, b FROM both_ways
        UNION
        SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
    ),
    least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
    SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.m, w.doc_id)) AS component_id,
        coalesce(d.n, 0) AS n_links
    FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least l ON l.a = w.doc_id
        LEFT JOIN degree d ON d.a = w.doc_id
"""

DECONTAMINATE = f"""
    WITH items AS (
        SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text", _LETTERS)} AS w FROM benchmark
    ),
    windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS n,
            array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
        FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0
    ),
    d AS (SELECT doc_id, {_words("text", _LETTERS)} AS w FROM documents),
    grams AS (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
        FROM d, (SELECT DISTINCT n FROM windows) s, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) t(i)
    ),
    found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON windows.n = grams.n AND windows.g = grams.g),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
    matched AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN matched ON matched.doc_id = d.doc_id
"""

COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    f AS MATERIALIZED (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(w[i : i + k - 1]) AS p, count(*) AS a
        FROM w, (VALUES (1), (2), (3), (4)) s(k), unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) t(i)
        GROUP BY 1, 2, 3
    ),
    candidates AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND a >= 30),
    cuts AS (
        SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, j,
            CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1 : j], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[j + 1 : c.k], ' ')
    ),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inner_phrases AS (
        SELECT DISTINCT lang, a, array_to_string(p[i : i + s - 1], ' ') AS phrase
        FROM candidates, (VALUES (2), (3)) t(s), unnest(range(1, CAST(k - s + 2 AS BIGINT))) u(i) WHERE s < k
    ),
    most AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY 1, 2),
    n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
    ranked AS (
        SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
        FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase
        WHERE m.most IS NULL OR CAST(100 AS HUGEINT) * m.most < 80 * b.a
    )
    SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n.n, score
    FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op3_mtree_topk": TOP_K,
    "op9_ngram_join": NGRAM_JOIN,
    "op10_decontaminate": DECONTAMINATE,
    "op13_collocations": COLLOCATIONS,
}
