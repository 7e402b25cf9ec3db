"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chat_format, decontaminate, exact_dedup, imatch, jaccard_join, kd_sharding, packed_ids, piece_fst, prefix_trie, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_piece_fst": piece_fst.op2_piece_fst,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_warc_revisits": warc.op5_warc_revisits,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_sharding": kd_sharding.op8_sharding,
        "op9_packed_ids": packed_ids.op9_packed_ids,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_imatch": imatch.op11_imatch,
        "op12_centroids": centroids.op12_centroids,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_warc_revisits": warc.OP5_SQL,
        "op6_chat_format": chat_format.OP6_SQL,
        "op10_decontamination": decontaminate.OP10_SQL,
        "op11_imatch": imatch.OP11_SQL,
        "op12_centroids": centroids.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
