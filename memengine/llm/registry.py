"""The queries of the corpus operators, and SQL for those that SQL can express."""

from memengine.llm import bpe, decontam, langid, lines, lm, packing, phrases, pii, quality, resampling, simhash, token_files, topk

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_line_dedup": lines.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_exact_topk": topk.query,
    "op5_language_id": langid.query,
    "op6_best_fit_packing": packing.query,
    "op7_token_files": token_files.query,
    "op8_personal_data": pii.query,
    "op9_pseudo_likelihood": lm.query,
    "op10_decontaminate": decontam.query,
    "op11_importance_resampling": resampling.query,
    "op12_byte_level_bpe": bpe.query,
    "op13_phrase_collocations": phrases.query,
}
ORACLE = {
    "op4_exact_topk": topk.ORACLE,
    "op10_decontaminate": decontam.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op13_phrase_collocations": phrases.ORACLE,
}
