"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from quantloom.llm import (
    byte_bpe,
    centroid_clusters,
    decontamination,
    exact_dedup,
    jaccard_join,
    pii_surrogates,
    pitman_yor,
    quality_rules,
    token_output,
    toxicity,
    url_filter,
    vector_codes,
    warc_fixity,
)

QUERIES = {
    "op1_pii_surrogates": pii_surrogates.op1_pii_surrogates,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_warc_fixity": warc_fixity.op6_warc_fixity,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pitman_yor": pitman_yor.op9_pitman_yor,
    "op10_token_output": token_output.op10_token_output,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_centroid_clusters": centroid_clusters.op12_centroid_clusters,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
ORACLE_SQL = {
    "op2_benchmark_decontamination": decontamination.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_warc_fixity": warc_fixity.SQL,
    "op7_url_filter": url_filter.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_centroid_clusters": centroid_clusters.SQL,
}
