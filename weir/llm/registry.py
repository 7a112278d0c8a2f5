"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.llm import op3_substrings, op6_kdtree, op7_jaccard, op9_licenses, op10_secrets, op11_warc, op12_filters, op13_centroids
from weir.llm.op1_mixing import op1_source_mixing
from weir.llm.op2_html import op2_html_text
from weir.llm.op4_media import op4_media_columns
from weir.llm.op5_quality import op5_quality
from weir.llm.op8_packing import op8_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_html_text": op2_html_text,
        "op3_substring_dedup": op3_substrings.op3_substring_dedup,
        "op4_media_columns": op4_media_columns,
        "op5_quality": op5_quality,
        "op6_exact_topk": op6_kdtree.op6_exact_topk,
        "op7_ngram_jaccard": op7_jaccard.op7_ngram_jaccard,
        "op8_packing": op8_packing,
        "op9_license_scan": op9_licenses.op9_license_scan,
        "op10_secret_scan": op10_secrets.op10_secret_scan,
        "op11_warc": op11_warc.op11_warc,
        "op12_filter_audit": op12_filters.op12_filter_audit,
        "op13_centroid_clusters": op13_centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": op3_substrings.SQL,
        "op6_exact_topk": op6_kdtree.SQL,
        "op7_ngram_jaccard": op7_jaccard.SQL,
        "op9_license_scan": op9_licenses.SQL,
        "op10_secret_scan": op10_secrets.SQL,
        "op11_warc": op11_warc.SQL,
        "op12_filter_audit": op12_filters.SQL,
        "op13_centroid_clusters": op13_centroids.SQL,
    }
