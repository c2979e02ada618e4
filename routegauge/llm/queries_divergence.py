"""The query of the source divergence audit and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.common import read_table
from routegauge.llm.divergence import audit


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language with its divergence, and the terms that set each source apart."""
    return audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM grid g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
p AS (
  SELECT lang, source, term, n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p
  FROM dense JOIN sizes USING (lang)
),
whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
q AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q
  FROM whole JOIN sizes USING (lang)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(CAST(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS BIGINT), 0) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""
