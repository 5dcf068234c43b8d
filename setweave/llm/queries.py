"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from setweave.llm.lm import op8_lm
from setweave.llm.media import op2_media
from setweave.llm.mixing import op5_mixing
from setweave.llm.packing import op7_packing
from setweave.llm.pii import op4_pii
from setweave.llm.quality import op6_quality
from setweave.llm.simhash import op1_simhash
from setweave.llm.token_files import op10_token_files
from setweave.llm.vectors import op9_embeddings
from setweave.llm.warc import op3_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_media": op2_media,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_lm": op8_lm,
    "op9_embeddings": op9_embeddings,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM x WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, x.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM x LEFT JOIN f ON x.d = f.d AND x.n >= 100""",
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.s),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.r = v.r LEFT JOIN n ON n.a = v.r""",
}
