"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from fxlake.llm import alignment, bpe, conversations, decontaminate, licenses, linededup, media, minhash, passages, pii, quality, sharding, tokencount

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_media": media.op4_media,
    "op5_pii": pii.op5_pii,
    "op6_passages": passages.op6_passages,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_minhash": minhash.op8_minhash,
    "op9_licenses": licenses.op9_licenses,
    "op10_fuzzy_lines": linededup.op10_fuzzy_lines,
    "op11_alignment": alignment.op11_alignment,
    "op12_sharding": sharding.op12_sharding,
    "op13_prefix_trie": conversations.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op12_sharding": sharding.OP12_SQL,
    "op13_prefix_trie": conversations.OP13_SQL,
}
