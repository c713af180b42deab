"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, divergence, embeddings, language, licences, minhash, mixing, prefixtrie, sharding, suffixdedup, tokencounts, tokenids, toxicity


def queries() -> dict:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_mixing": mixing.op2_mixing,
        "op3_minhash": minhash.op3_minhash,
        "op4_language": language.op4_language,
        "op5_token_ids": tokenids.op5_token_ids,
        "op6_suffix_dedup": suffixdedup.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": tokencounts.op8_token_counts,
        "op9_sharding": sharding.op9_sharding,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_licences": licences.op11_licences,
        "op12_divergence": divergence.op12_divergence,
        "op13_prefix_trie": prefixtrie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": embeddings.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op3_minhash": minhash.OP3_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op12_divergence": divergence.OP12_SQL,
        "op13_prefix_trie": prefixtrie.OP13_SQL,
    }
