"""Operators for training-data pipelines; ``QUERIES`` and ``ORACLES`` are what ``__spark_entry__`` registers."""

from quernel.llm import bpe, fingerprint, html_text, jaccard, licenses, mixing, resampling, rules, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_bpe": bpe.op3_bpe,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_licenses": licenses.op7_licenses,
    "op8_quality_classifier": resampling.op8_quality_classifier,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_url_filters": urls.op10_url_filters,
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op4_ngram_jaccard": jaccard.ORACLE}
