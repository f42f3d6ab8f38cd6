"""Name -> query and name -> DuckDB SQL of the training-data operators."""

from __future__ import annotations

from quillgraph.llm import byte_bpe, centroids, html_extract, importance, jaccard_join, order_minhash, quality_rules, sharding, source_mix, substring_chains, suffix_dedup, suffix_tree_lm, warc_revisit

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_chains": substring_chains.op2_substring_chains,
    "op3_order_minhash": order_minhash.op3_order_minhash,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_suffix_tree_lm": suffix_tree_lm.op6_suffix_tree_lm,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_warc_revisit": warc_revisit.op9_warc_revisit,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_centroids": centroids.op11_centroids,
    "op12_importance": importance.op12_importance,
    "op13_shards": sharding.op13_shards,
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_warc_revisit": warc_revisit.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
}
