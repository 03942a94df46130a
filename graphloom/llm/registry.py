"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe_codec, hard_negatives, lexical, line_dedup, lm_score, minhash, ngram_join, packing, quality, substring_dedup, token_counts, topk, warc


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_bpe_codec": bpe_codec.query,
        "op3_line_dedup": line_dedup.query,
        "op4_lm_score": lm_score.query,
        "op5_best_fit_packing": packing.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_topk_search": topk.query,
        "op8_quality_rules": quality.query,
        "op9_warc": warc.query,
        "op10_token_counts": token_counts.query,
        "op11_ranked_lexical_search": lexical.query,
        "op12_minhash_near_dedup": minhash.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk_search": topk.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_ranked_lexical_search": lexical.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
