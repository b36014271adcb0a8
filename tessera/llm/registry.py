"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import align, bpe, chat, decontaminate, jaccard, langid, privacy, quality, repair, secrets, sharding, suffix, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontaminate": decontaminate.query,
    "op2_toxicity": toxicity.query,
    "op3_jaccard": jaccard.query,
    "op4_bpe": bpe.query,
    "op5_chat": chat.query,
    "op6_langid": langid.query,
    "op7_suffix_array": suffix.query,
    "op8_sharding": sharding.query,
    "op9_secrets": secrets.query,
    "op10_quality": quality.query,
    "op11_alignment": align.query,
    "op12_privacy": privacy.query,
    "op13_repair": repair.query,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op3_jaccard": jaccard.SQL,
    "op5_chat": chat.SQL,
    "op13_repair": repair.SQL,
}
