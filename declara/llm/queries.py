"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from declara.llm import (
    centroid_clustering, disclosure, fingerprints, html_extraction, language_id, license_scans, ngram_join, packing, quality_rules, sentencepiece_nbest,
    source_divergence, token_counts, url_filters,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_packing": packing.query,
    "op3_sentencepiece_nbest": sentencepiece_nbest.query,
    "op4_license_scans": license_scans.query,
    "op5_html_extraction": html_extraction.query,
    "op6_token_counts": token_counts.query,
    "op7_fingerprints": fingerprints.query,
    "op8_url_filters": url_filters.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_language_id": language_id.query,
    "op11_source_divergence": source_divergence.query,
    "op12_pii_sanitisation": disclosure.query,
    "op13_centroid_clustering": centroid_clustering.query,
}

ORACLES: dict[str, str] = {
    "op11_source_divergence": source_divergence.SQL,
    "op13_centroid_clustering": centroid_clustering.SQL,
}
