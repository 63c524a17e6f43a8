"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from fieldloom.llm import chaining, contexttree, convnet, credentials, divergence, fingerprints, jaccardjoin, mixing, packing, prefixtrie, quality, tokencounts, tokenstore

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_store": tokenstore.op2_token_store,
    "op3_lm_scoring": contexttree.op3_lm_scoring,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality_classifier": convnet.op7_quality_classifier,
    "op8_substring_dedup": chaining.op8_substring_dedup,
    "op9_token_counts": tokencounts.op9_token_counts,
    "op10_ngram_jaccard_join": jaccardjoin.op10_ngram_jaccard_join,
    "op11_secret_scan": credentials.op11_secret_scan,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE = {"op4_mixing": mixing.OP4_SQL, "op5_quality_rules": quality.OP5_SQL, "op11_secret_scan": credentials.OP11_SQL, "op12_prefix_trie": prefixtrie.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
