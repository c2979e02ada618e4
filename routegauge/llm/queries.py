"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routegauge.llm.queries_decontamination import LEAKS_SQL, op7_decontamination
from routegauge.llm.queries_divergence import DIVERGENCE_SQL, op13_source_divergence
from routegauge.llm.queries_exact_dedup import EXACT_SQL, op10_exact_dedup
from routegauge.llm.queries_html_text import op5_html_extraction
from routegauge.llm.queries_jaccard import JACCARD_SQL, op11_ngram_jaccard_join
from routegauge.llm.queries_line_dedup import op6_line_dedup
from routegauge.llm.queries_merkle import MERKLE_SQL, op12_merkle_manifest
from routegauge.llm.queries_packing import op3_best_fit_packing
from routegauge.llm.queries_quality import op8_quality_classifier
from routegauge.llm.queries_simhash import op9_simhash_near_dedup
from routegauge.llm.queries_token_counts import op1_token_counts
from routegauge.llm.queries_toxicity import op4_toxicity
from routegauge.llm.queries_url_filter import URL_SQL, op2_url_filters


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = (
        op1_token_counts, op2_url_filters, op3_best_fit_packing, op4_toxicity, op5_html_extraction, op6_line_dedup,
        op7_decontamination, op8_quality_classifier, op9_simhash_near_dedup, op10_exact_dedup, op11_ngram_jaccard_join,
        op12_merkle_manifest, op13_source_divergence,
    )
    return {p.__name__: p for p in plans}


def llm_statements() -> dict[str, str]:
    return {
        "op2_url_filters": URL_SQL,
        "op7_decontamination": LEAKS_SQL,
        "op10_exact_dedup": EXACT_SQL,
        "op11_ngram_jaccard_join": JACCARD_SQL,
        "op12_merkle_manifest": MERKLE_SQL,
        "op13_source_divergence": DIVERGENCE_SQL,
    }
