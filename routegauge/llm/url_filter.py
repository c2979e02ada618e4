"""URL filters by hashed expressions, in DataFrame functions only.

A URL is expanded into expressions: every suffix of its host at a dot, joined with every prefix of its path that is as long
as some rule's path. Expressions and rules are joined on the first hexadecimal digits of their SHA-256; the full digests
are then compared, and of the rules that remain the longest decides (of equally long ones, block before allow, then
the first in string order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegauge.llm.common import fresh, lower_ascii, text_or_empty

PREFIX_DIGITS = 8
BROADCAST_ROWS = 200_000


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return lower_ascii(F.regexp_extract(text_or_empty(url), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(text_or_empty(url), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Array of (host suffix, path prefix), for the given lengths of path prefixes."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.char_length(path))
    prefixes = F.transform(lengths, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def with_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule (host and path of the deciding rule, else null) and verdict.

    ``rules`` has host, path and action (block or allow); a rule fits its host and all subdomains where the path of the
    URL starts with its path. Rows of rules with a null are passed over, repeated ones count once. A null URL, or one
    without ``://``, has an empty host and path. Repeated rows get the same answer each; columns of ``pages`` with the new
    names are replaced. Every URL is judged once, however often it occurs.
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "action").dropna().distinct()
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())  # no more than path lengths
    digest = _digest(F.col("host"), F.col("path"))
    known = rules.select(
        F.concat("host", "path").alias("rule"), "action", digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("short")
    )
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    key, best_of = fresh(pages, "url_key", "best_rule_")
    urls = pages.select(F.col(f"`{url}`").alias(key)).distinct()
    found = urls.select(key, F.explode(expressions(host_of(key), path_of(key), lengths) if lengths else F.array()
                                       .cast("array<struct<host:string,path:string>>")).alias("e"))
    found = found.select(key, _digest(F.col("e.host"), F.col("e.path")).alias("full"))
    met = found.withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).join(known, "short").filter("full = digest")
    first = F.struct((-F.char_length("rule")).alias("n"), (F.col("action") != "block").alias("a"), F.col("rule"), F.col("action"))
    best = met.groupBy(key).agg(F.min(first).alias(best_of))
    joined = pages.withColumns({"host": host_of(url), "path": path_of(url)}).join(best, F.col(f"`{url}`") == F.col(key), "left")
    return joined.withColumns({
        "rule": F.col(best_of)["rule"], "verdict": F.coalesce(F.col(best_of)["action"], F.lit(default)),
    }).drop(key, best_of)
