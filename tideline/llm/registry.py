"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_trie, chat_format, exact_dedup, license_scan, minhash, packing, quality, sstable, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_near_duplicates": minhash.op1_near_duplicates,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_packing": packing.op3_packing,
        "op4_compression_bands": quality.op4_compression_bands,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sorted_shards": sstable.op7_sorted_shards,
        "op8_bpe_trie": bpe_trie.op8_bpe_trie,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.OP2_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
