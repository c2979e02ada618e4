"""The query of the n-gram Jaccard join and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.common import read_table
from routegauge.llm.jaccard_join import linked_documents


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the size of its set of five-word shingles, and the class of near copies it belongs to."""
    return linked_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT row_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh
  FROM w
),
sizes AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id),
met AS (SELECT a.row_id AS x, b.row_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id),
links AS (SELECT x, y FROM met JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON s.x = r.y)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, min(o.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (row_id) LEFT JOIN reach r ON r.x = w.row_id LEFT JOIN w o ON o.row_id = r.y
GROUP BY w.row_id, w.doc_id, n
"""
