"""Ranked ids out of answer text, as array columns. An unparseable answer gives an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routegauge import fixed_values as fv


def _found(text: Column, pattern: str) -> Column:
    """The first match, NULL without one. It is searched for once, where a test and its extracts would search again."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0))


def _to_id(digits: Column) -> Column:
    # Ids too long for BIGINT keep their place in the list but can match no item.
    return F.coalesce(digits.try_cast("bigint"), -F.abs(F.xxhash64(F.ltrim(digits, F.lit("0")))) - 1)


def rec_ids(text: Column) -> Column:
    """Item ids in answer order, duplicates kept. The first form that matches decides, even without ids."""
    text = F.coalesce(text, F.lit(""))
    # of every form the whole match is taken, for the words and marks around its list hold no digits
    body = F.coalesce(
        _found(text, fv.REC_TAGGED),
        _found(text, fv.REC_INLINE),
        F.when(text.rlike(fv.REC_BARE_LIST), text),
        F.regexp_extract(text, fv.REC_BRACKET, 0),
    )
    return F.transform(F.regexp_extract_all(body, F.lit(r"(\d+)"), F.lit(1)), _to_id)


def bracket_ids(text: Column) -> Column:
    """Upper-cased ids in square brackets, duplicates kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fv.IR_BRACKET_ID), F.lit(1))
    return F.transform(found, lambda s: F.upper(s))


def ir_ids(text: Column) -> Column:
    """Passage ids of the tagged part, or of the whole text without a tag; the first mention counts."""
    text = F.coalesce(text, F.lit(""))
    body = F.when(text.rlike(fv.IR_TAGGED), F.regexp_extract(text, fv.IR_TAGGED, 1)).otherwise(text)
    return F.array_distinct(bracket_ids(body))
