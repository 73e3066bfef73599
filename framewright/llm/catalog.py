"""Queries opN_<name> of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from framewright.llm import (
    bpe, caps, chat_format, decontaminate, exact_dedup, fill_middle, license_scan, minhash, quality, recompress, secret_scan, spelling, token_store,
)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op5_substring_dedup": recompress.op5_substring_dedup,
    "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
    "op4_token_files": token_store.op4_token_files,
    "op2_bpe_encoding": bpe.op2_bpe_encoding,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op6_license_scan": license_scan.op6_license_scan,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_cap_near_vectors": caps.op12_cap_near_vectors,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    # the parts of op6 and op8 that SQL can say
    "license_base": license_scan.license_base,
    "secret_base": secret_scan.secret_base,
}
ORACLES = {
    "op5_substring_dedup": recompress.OP5_SQL,
    "op10_minhash_near_dedup": minhash.OP10_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
    "license_base": license_scan.BASE_SQL,
    "secret_base": secret_scan.BASE_SQL,
}
