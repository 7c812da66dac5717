"""Queries of the operators in this subpackage, and the same in SQL where SQL can express them."""

from noticeloom.llm import decontaminate, importance, lexical_search, mixing, ngram_join, phrases, pieces, pii, quality_rules, secret_scan, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_importance_resampling": importance.op1_importance_resampling,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_pii_weak_supervision": pii.op3_pii_weak_supervision,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.OP2_SQL,
    "op4_ngram_jaccard_join": ngram_join.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
