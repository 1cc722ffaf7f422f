"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .embedding_dedup import op9_embedding_dedup
from .minhash_dedup import op1_near_duplicates
from .neighbours import op3_neighbours
from .packing import op4_packing
from .pii import op2_pii
from .sharding import op5_shards
from .token_counts import op8_token_counts
from .toxicity import op7_toxicity
from .warc import op10_warc

QUERIES = {"op1_near_duplicates": op1_near_duplicates, "op2_pii": op2_pii, "op3_neighbours": op3_neighbours, "op4_packing": op4_packing, "op5_shards": op5_shards, "op6_bpe": op6_bpe, "op7_toxicity": op7_toxicity, "op8_token_counts": op8_token_counts, "op9_embedding_dedup": op9_embedding_dedup, "op10_warc": op10_warc}
#: What SQL can express: all pairs within size bounds, or within labels, and what can be reached over links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(array_to_string(w, ' '))] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.s) AS m, len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0 AND 100 * least(len(a.s), len(b.s)) >= 85 * greatest(len(a.s), len(b.s))),
edge AS (SELECT a, b FROM near WHERE 100 * k >= 85 * (m + n - k) UNION ALL SELECT b, a FROM near WHERE 100 * k >= 85 * (m + n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c LEFT JOIN (SELECT a, count(*) AS n FROM edge GROUP BY a) n ON n.a = c.vec_id
"""

ORACLE: dict[str, str] = {"op1_near_duplicates": NEAR_DUPLICATES, "op9_embedding_dedup": EMBEDDING_DEDUP}
