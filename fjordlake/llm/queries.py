"""The operators' registered queries, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from ..sources.shared import ship_package
from . import bpe_codec, decontaminate, license_scan, media, near_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter


def _with_package(f):
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_media_columns": media.op1_media_columns,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_bpe_codec": bpe_codec.op5_bpe_codec,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_url_filter": url_filter.op10_url_filter,
    }
    return {name: _with_package(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near_dedup.SQL, "op6_substring_dedup": substring_dedup.SQL, "op8_decontaminate": decontaminate.SQL, "op10_url_filter": url_filter.SQL}
