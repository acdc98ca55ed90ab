"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from glenfare.llm import exact_dedup, fill_in_middle, html_text, language_id, license_scan, nearest, packing, quality_rules, sentencepiece_codec, sharding, simhash, url_filter, whitening

MODULES = [exact_dedup, fill_in_middle, html_text, language_id, license_scan, nearest, packing, quality_rules, sentencepiece_codec, sharding, simhash, url_filter, whitening]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
