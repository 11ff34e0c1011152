"""Names of the corpus queries, with their functions and SQL."""

from __future__ import annotations

from . import bpe, chat, importance, kneser_ney, language_id, line_dedup, minhash, mixing, quality_rules, top_k


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_importance_resampling": importance.op3_importance_resampling,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_chat_format": chat.op6_chat_format,
        "op7_language_id": language_id.op7_language_id,
        "op8_exact_top_k": top_k.op8_exact_top_k,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op9_rule_ablation": quality_rules.op9_rule_ablation,
        "op10_kneser_ney": kneser_ney.op10_kneser_ney,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
