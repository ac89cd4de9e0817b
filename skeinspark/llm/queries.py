"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from skeinspark.llm import bpe, decontaminate, exact_dedup, language_model, line_dedup, near_dup, pii, quality, secrets, warc

QUERIES = {
    "op1_lm_score": language_model.op1_lm_score,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_bpe": bpe.op3_bpe,
    "op4_warc_revisit": warc.op4_warc_revisit,
    "op5_quality": quality.op5_quality,
    "op6_secrets": secrets.op6_secrets,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pii": pii.op9_pii,
    "op10_ngram_jaccard": near_dup.op10_ngram_jaccard,
}

SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_warc_revisit": warc.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_ngram_jaccard": near_dup.OP10_SQL,
}
