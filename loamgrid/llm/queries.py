"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import media, mixing, neardup, packing, quality, repeats, scoring, sharding, topk, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_toxicity": toxicity.query,
        "op3_media": media.query,
        "op4_topk": topk.query,
        "op5_quality": quality.query,
        "op6_sharding": sharding.query,
        "op7_packing": packing.query,
        "op8_repeats": repeats.query,
        "op9_scoring": scoring.query,
        "op10_neardup": neardup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op4_topk": topk.SQL}
