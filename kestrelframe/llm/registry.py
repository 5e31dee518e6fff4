"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import conversation_repair, decontamination, host_reputation, jaccard_join, packing, quality_classifier, quality_rules, secret_scan, simhash, suffix_dedup, token_ledger, toxicity, vector_codes

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_best_fit_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_ledger.query,
    "op6_quality_rules": quality_rules.query,
    "op7_benchmark_decontamination": decontamination.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_url_filters": host_reputation.query,
    "op10_secret_scans": secret_scan.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_jaccard_join": jaccard_join.query,
    "op13_vector_codes": vector_codes.query,
}

ORACLE_SQL = {"op9_url_filters": host_reputation.ORACLE_SQL, "op12_jaccard_join": jaccard_join.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
