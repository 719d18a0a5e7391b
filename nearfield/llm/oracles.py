"""SQL counterparts of the registered queries, where SQL can say them.

The others have no SQL form: learned models (op2, op5), character models with
cross-fitted folds (op3), tokenizers (op4, op6, op10), CRC-32 (op12, op13),
eigenvectors (op11), a bisected exponent (op9), shingle sets over whole texts, which
SQL compares too slowly (op1), and leftmost matches with positions (op8).
"""

from __future__ import annotations

NEAR_DUPLICATES = """
WITH RECURSIVE cast_rows AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
),
good AS (
    SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM cast_rows
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
),
reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM good
    UNION
    SELECT r.vec_id, l.y FROM reached r JOIN links l ON l.x = r.other
),
components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
degrees AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN components c USING (vec_id) LEFT JOIN degrees d USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_tile_near_duplicates": NEAR_DUPLICATES}
