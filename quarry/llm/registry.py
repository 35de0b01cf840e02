"""The queries of this subpackage and, where SQL can express them, the SQL they must equal."""

from __future__ import annotations

from quarry.llm import bpe, chat, embeddings, exact_dedup, infill, lm, minhash, packing, pii, prefix_trie, quality, substrings, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op4_repeated_substrings": substrings.op4_repeated_substrings,
    "op5_pii": pii.op5_pii,
    "op3_near_embeddings": embeddings.op3_near_embeddings,
    "op6_quality": quality.op6_quality,
    "op7_minhash": minhash.op7_minhash,
    "op8_bpe": bpe.op8_bpe,
    "op9_chat_format": chat.op9_chat_format,
    "op10_lm_score": lm.op10_lm_score,
    "op11_warc": warc.op11_warc,
    "op12_infill": infill.op12_infill,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op9_chat_format": chat.SQL,
    "op11_warc": warc.SQL,
    "op12_infill": infill.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
