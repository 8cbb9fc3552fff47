"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, divergence, language, ngram_join, packing, prefix_counts, prefix_trie, repetition, spiece, suffix_dedup, toxicity, vector_dedup, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_sentencepiece": spiece.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_webp": webp.op5_webp,
        "op6_token_counts": prefix_counts.op6_token_counts,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_language_id": language.op8_language_id,
        "op9_vector_dedup": vector_dedup.op9_vector_dedup,
        "op10_chat_format": chat.op10_chat_format,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_repetition": repetition.op12_repetition,
        "op13_divergence": divergence.op13_divergence,
    }


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Texts' sets of word n-grams, links by their sizes and intersections, and reachability.
_NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id) USING (vec_id)"""

#: crc32 of an id's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"

#: Prefixes of rebuilt conversations as nodes; sums over subtrees by each node's prefixes.
_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS b, ({_CRC}) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
a AS (SELECT h.c, 0 AS part, t.d, r, x FROM h JOIN t ON t.c = h.b AND t.d <= h.h UNION ALL SELECT h.c, 1, t.d, r, x FROM h JOIN t ON t.c = h.c AND t.d > h.h),
p AS (SELECT c, row_number() OVER w AS d, length(x) AS n, string_agg(sha256(length(r) || ':' || r || x), '') OVER w AS path FROM a WINDOW w AS (PARTITION BY c ORDER BY part, d)),
q AS (SELECT c, d, n, path FROM p UNION ALL SELECT c, 0, 0, '' FROM h), l AS (SELECT c, max(d) AS d FROM q GROUP BY c),
n AS (SELECT d, path, min(c) AS c, count(*) AS m, (count(*) - 1) * max(n) AS v FROM q GROUP BY d, path),
e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM q JOIN l USING (c, d) GROUP BY path),
u AS (SELECT n.d, n.c, n.path, n.m, n.v, coalesce(o.path, '') AS above, CASE WHEN n.d > 0 THEN coalesce(o.c, z.c) END AS parent FROM n LEFT JOIN (SELECT c AS i, d + 1 AS d, path FROM q) g ON g.i = n.c AND g.d = n.d LEFT JOIN n o ON o.path = g.path AND o.d = n.d - 1 LEFT JOIN n z ON z.d = 0 AND n.d = 1),
k AS (SELECT d - 1 AS d, above AS path, count(*) AS k FROM u WHERE d > 0 GROUP BY ALL),
s AS (SELECT q.d, q.path, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum(u.v) AS saved FROM u LEFT JOIN k ON k.d = u.d AND k.path = u.path JOIN q ON q.c = u.c AND q.d <= u.d GROUP BY q.d, q.path)
SELECT u.c AS conv_id, u.d AS depth, parent AS parent_conv_id, u.m AS n_convs, coalesce(k.k, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM u LEFT JOIN k ON k.d = u.d AND k.path = u.path LEFT JOIN e ON e.path = u.path JOIN s ON s.d = u.d AND s.path = u.path"""

_AUDIT = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3), v AS (SELECT lang, count(*) AS v, sum(m)::BIGINT AS nl FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL), g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p, 1 + 1000000000 * (k.m + 1) // (v.nl + v.v) AS q FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; tests hold the others against brute force."""
    return {"op2_ngram_join": _NGRAM_JOIN, "op9_vector_dedup": _VECTORS, "op11_prefix_trie": _TRIE, "op13_divergence": _AUDIT}
