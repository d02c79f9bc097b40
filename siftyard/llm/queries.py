"""Queries of the training-data operators and their DuckDB SQL, for the driver's entry module."""

from siftyard.llm import bpe, chat, decontaminate, langid, license_scan, near_dedup, quality, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_bpe": bpe.op2_bpe,
    "op3_license": license_scan.op3_license,
    "op4_chat": chat.op4_chat,
    "op5_quality": quality.op5_quality,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secrets": secrets.op9_secrets,
    "op10_langid": langid.op10_langid,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_chat": chat.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
}
