"""The queries of this subpackage and the SQL that gives the same rows."""

from levelground.llm import alignment, decontaminate, exact_dedup, importance, jaccard_join, language, licences, line_dedup, packing, pii, secrets, suffix_dedup, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii,
        jaccard_join.op2_ngram_jaccard,
        language.op3_language_id,
        secrets.op4_secret_scan,
        line_dedup.op5_line_dedup,
        decontaminate.op6_benchmark_decontamination,
        packing.op7_best_fit_packing,
        exact_dedup.op8_exact_dedup,
        licences.op9_licence_scan,
        token_counts.op10_token_counts,
        suffix_dedup.op11_suffix_dedup,
        alignment.op12_token_alignment,
        importance.op13_importance_resampling,
    )
}
ORACLES = {"op6_benchmark_decontamination": decontaminate.SQL, "op8_exact_dedup": exact_dedup.SQL, "op13_importance_resampling": importance.SQL}
