"""The query of the URL filters and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.common import read_table
from routegauge.llm.url_filter import with_verdicts

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host and path of its URL, the rule that decides, and the verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = with_verdicts(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


URL_SQL = r"""
WITH rules(host, path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), judged AS (
  SELECT DISTINCT p.host AS h, p.path AS q, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, r.action DESC) AS n
  FROM (SELECT DISTINCT host, path FROM p) AS p JOIN rules AS r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.action, 'allow') AS verdict
FROM p LEFT JOIN judged AS j ON j.h = p.host AND j.q = p.path AND j.n = 1
"""
