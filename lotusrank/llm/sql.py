"""The SQL of those queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["p1_found"] = r"""
WITH i AS (SELECT qid, unnest(answer) AS item, unnest(score) AS score FROM submission),
q AS (SELECT qid, item, max(score) AS s FROM i WHERE qid IS NOT NULL AND item IS NOT NULL AND trim(item) <> '' AND score IS NOT NULL AND NOT isnan(score) GROUP BY qid, item),
c AS (SELECT DISTINCT doc_id, chunk_id, chunk_idx, bm25 FROM chunks WHERE doc_id IS NOT NULL AND bm25 IS NOT NULL AND NOT isnan(bm25))
SELECT 'question' AS grp, qid AS grp_key, item FROM q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, item) <= 5
UNION ALL SELECT 'document', doc_id, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bm25 DESC, chunk_idx) <= 3"""

# With two scores, the oriented first component weighs both by 1 / sqrt(2), whatever their correlation.
_RANKED = r"""
WITH p AS (SELECT DISTINCT qid, chunk_idx, CASE WHEN NOT isnan(bm25) THEN bm25 END AS a, CASE WHEN NOT isnan(dense) THEN dense END AS b FROM chunks WHERE qid IS NOT NULL),
r AS (SELECT qid, chunk_idx,
 CASE WHEN a IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY qid, a IS NULL ORDER BY a) + (count(*) OVER (PARTITION BY qid, a) - 1) / 2.0) / (count(a) OVER (PARTITION BY qid) + 1) END AS ra,
 CASE WHEN b IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY qid, b IS NULL ORDER BY b) + (count(*) OVER (PARTITION BY qid, b) - 1) / 2.0) / (count(b) OVER (PARTITION BY qid) + 1) END AS rb FROM p),
m AS (SELECT avg(ra) AS ma, stddev_pop(ra) AS sa, avg(rb) AS mb, stddev_pop(rb) AS sb FROM r),
x AS (SELECT qid, chunk_idx, round(((ra - ma) / sa + (rb - mb) / sb) / sqrt(2), 9) + 0.0 AS projection FROM r, m)"""
ORACLE["p4_ranked"] = _RANKED + " SELECT qid, chunk_idx, round(projection, 6) + 0.0 AS projection, row_number() OVER (PARTITION BY qid ORDER BY projection DESC, chunk_idx) AS position FROM x"

_TERMS = r"""
WITH c AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM c WHERE text IS NOT NULL),
f AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM t GROUP BY term),
k AS (SELECT *, CASE WHEN records <= 1 THEN 'rare' WHEN records > (SELECT count(*) * 7 // 10 FROM c) THEN 'common' END AS mark FROM f)"""
ORACLE["p5_found"] = _TERMS + " SELECT term, mark FROM k WHERE mark IS NOT NULL"
ORACLE["p5_terms"] = _TERMS + " SELECT term, occurrences::BIGINT AS occurrences, records, mark FROM k"

ORACLE["p5_ngrams"] = r"""
WITH c AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
t AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM c WHERE text IS NOT NULL),
g AS (SELECT chunk_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM t, (SELECT unnest([1, 2, 3]) AS n))
SELECT term, n::INT AS n, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM g GROUP BY term, n"""

ORACLE["p6_found"] = r"""
WITH v AS (SELECT chunk_idx AS id, min(dense)::DOUBLE[] AS x FROM emb WHERE dense IS NOT NULL GROUP BY chunk_idx),
u AS (SELECT id, x FROM v WHERE list_inner_product(x, x) > 0),
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 9) AS c FROM u a JOIN u b ON a.id <> b.id),
n AS (SELECT a, b FROM s WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT n.a AS chunk_a, n.b AS chunk_b FROM n JOIN n m ON n.a = m.b AND n.b = m.a WHERE n.a < n.b"""

_COUNT = r"len(list_filter(regexp_split_to_array(regexp_replace({0}, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g'), '[\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]+'), lambda w: w <> ''))"
ORACLE["p7_found"] = (f"SELECT DISTINCT 'context.passage' AS fld, doc_id AS rec_id FROM context WHERE doc_id IS NOT NULL AND {_COUNT.format('passage')} > 350 "
                      f"UNION ALL SELECT DISTINCT 'chunks.text', chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND {_COUNT.format('text')} > 350")
