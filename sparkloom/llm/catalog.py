"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, imatch, language, lm_score, media, merkle, mixing, negatives, pii, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_media": media.op1,
        "op2_language": language.op2,
        "op3_bpe": bpe.op3,
        "op4_pii": pii.op4,
        "op5_lm_score": lm_score.op5,
        "op6_quality": quality.op6,
        "op7_imatch": imatch.op7,
        "op8_mixing": mixing.op8,
        "op9_toxicity": toxicity.op9,
        "op10_simhash": simhash.op10,
        "op11_merkle": merkle.op11,
        "op12_negatives": negatives.op12,
        "op13_warc": warc.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE, "op11_merkle": merkle.ORACLE, "op12_negatives": negatives.ORACLE, "op13_warc": warc.ORACLE}
