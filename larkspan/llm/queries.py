"""The registered queries of this subpackage and their SQL."""

from larkspan.llm import decontaminate, exact, fingerprints, jaccard, packing, paragraphs, quality, resampling, secrets, substrings, toxicity, urls, vector_codes

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_paragraph_dedup": paragraphs.op10_paragraph_dedup,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op7_exact_dedup": exact.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op11_fingerprints": fingerprints.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
