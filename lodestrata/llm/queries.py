"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, exact_dedup, katz, license_scan, ngram_jaccard, packing, quality, token_counts

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_token_counts": token_counts.op4_token_counts,
    "rollup_plain": token_counts.rollup_plain,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_ngram_jaccard": ngram_jaccard.op7_ngram_jaccard,
    "op8_quality": quality.op8_quality,
    "op9_katz_lm": katz.op9_katz_lm,
    "op10_license_scan": license_scan.op10_license_scan,
}
ORACLES = {
    "op1_packing": packing.ORACLE,
    "op7_ngram_jaccard": ngram_jaccard.ORACLE,
    "op2_embedding_dedup": embedding_dedup.ORACLE,
    "rollup_plain": token_counts.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
}
