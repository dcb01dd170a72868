"""SQL of the queries that SQL can express."""

from __future__ import annotations

# crc32 of a decimal number, four bits at a time. The sixteen numbers are fixed values: the table of the
# polynomial for four bits.
_CRC_TABLE = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""


def _crc32(number: str) -> str:
    digits = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: [x::BIGINT, 3])"
    step = f"xor(a >> 4, ({_CRC_TABLE}::BIGINT[])[1 + (xor(a, b) & 15)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({digits})), lambda a, b: {step}), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_conversation_trie": rf"""
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p,
        coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT c, {_crc32("c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
    SELECT i.c, 0 AS own, o.p, o.r, o.x FROM ids i JOIN own o ON o.c = i.c - i.c % 20 AND o.p < i.h
    UNION ALL
    SELECT i.c, 1, o.p, o.r, o.x FROM ids i JOIN own o ON o.c = i.c AND o.p >= i.h
),
numbered AS (
    SELECT c, row_number() OVER w AS d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(sha256(length(r) || ':' || r || x), '') OVER w AS key
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, p)
),
members AS (SELECT c, d, words, key FROM numbered UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (
    SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY key, d
),
ending AS (
    SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
    FROM (SELECT c, max(d) AS d, arg_max(key, d) AS key FROM members GROUP BY c) GROUP BY key
),
linked AS (
    SELECT n.*, up.conv_id AS parent, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.key[:64 * n.d] = n.key) AS kids
    FROM nodes n LEFT JOIN nodes up ON up.d = n.d - 1 AND up.key = n.key[:64 * (n.d - 1)]
),
lifted AS (
    SELECT key[:64 * a] AS top, n_convs, words, kids
    FROM (SELECT key, n_convs, words, kids, unnest(generate_series(0, d)) AS a FROM linked)
),
subtrees AS (
    SELECT top, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum((n_convs - 1) * words)::BIGINT AS saved
    FROM lifted GROUP BY top
)
SELECT n.conv_id, n.d::BIGINT AS depth, n.parent AS parent_conv_id, n.n_convs, n.kids AS n_children,
    s.leaves AS n_leaves, s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM linked n JOIN subtrees s ON s.top = n.key LEFT JOIN ending e ON e.key = n.key
""",
    "op12_embedding_dedup": """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a
    JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
),
components AS (SELECT a, min(b) AS c FROM reached GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
""",
    "op13_hard_negatives": """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor, x.vec_id AS other, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
    FROM vectors a JOIN vectors x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v) WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
),
negatives AS (
    SELECT p.anchor AS anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score,
        n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS place
    FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
        AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 3
""",
}
