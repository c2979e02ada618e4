"""The query of the Merkle manifest and the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegauge.llm.common import read_table
from routegauge.llm.merkle_manifest import with_proofs

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its leaf, the roots, the digest of its proof, and whether the row as presented verifies."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    presented = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    proofs = with_proofs(docs, FIELDS, presented=presented)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _encoded(value: str) -> str:
    body = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen({body}) AS VARCHAR) || ':' || {body} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text with the reflected polynomial, bit by bit."""
    bits = "list_reduce(list_prepend(xor(acc, x), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda r, i: xor(r // 2, (r % 2) * 3988292384))"
    codes = f"[CAST(ord(c) AS BIGINT) FOR c IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, x: {bits}), 4294967295)"


MERKLE_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS presented
  FROM documents
),
leaves AS (
  SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n
  FROM base
),
nodes(tree, level, idx, digest, n) AS (
  SELECT tree, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2
),
subroots AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS branch, count(*) OVER () AS branches
  FROM nodes WHERE n = 1
),
tops(level, idx, digest, n) AS (
  SELECT 0, branch, subroot, branches FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, idx // 2
),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
steps AS (
  SELECT l.doc_id, l.tree, l.idx AS place, s.level, (l.idx >> s.level) % 2 AS side, o.digest AS sibling
  FROM leaves l JOIN heights h USING (tree), LATERAL (SELECT unnest(range(h.height)) AS level) s
  LEFT JOIN nodes o ON o.tree = l.tree AND o.level = s.level AND o.idx = xor(l.idx >> s.level, 1)
  UNION ALL
  SELECT l.doc_id, l.tree, l.idx, h.height + s.level, (b.branch >> s.level) % 2, o.digest
  FROM leaves l JOIN heights h USING (tree) JOIN subroots b USING (tree),
    LATERAL (SELECT unnest(range((SELECT max(level) FROM tops))) AS level) s
  LEFT JOIN tops o ON o.level = s.level AND o.idx = xor(b.branch >> s.level, 1)
),
paths AS (
  SELECT tree, place, list({{'side': side, 'sibling': sibling}} ORDER BY level) AS path, coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings
  FROM steps GROUP BY tree, place
),
folds(tree, idx, digest, path) AS (
  SELECT l.tree, l.idx, l.presented, coalesce(p.path, []) FROM leaves l LEFT JOIN paths p ON p.tree = l.tree AND p.place = l.idx
  UNION ALL
  SELECT tree, idx, CASE WHEN path[1].sibling IS NULL THEN sha256(digest) WHEN path[1].side = 1 THEN sha256(path[1].sibling || digest)
    ELSE sha256(digest || path[1].sibling) END, path[2:]
  FROM folds WHERE len(path) > 0
)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root,
  f.digest = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN folds f ON f.tree = l.tree AND f.idx = l.idx AND len(f.path) = 0
  LEFT JOIN paths p ON p.tree = l.tree AND p.place = l.idx, (SELECT digest FROM tops WHERE n = 1) t
"""
