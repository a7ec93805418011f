"""The registered queries of this package and their DuckDB texts."""

from __future__ import annotations

from lintel.llm import anchors, ann, bpe, importance, katz, leaks, license_scan, mixing, simhash, suffixes, toxicity, trie, vafile

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substring_dedup": anchors.op2_substring_dedup,
    "op3_ann": ann.op3_ann,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_topk": vafile.op6_topk,
    "op7_bpe": bpe.op7_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_katz": katz.op10_katz,
    "op11_decontaminate": leaks.op11_decontaminate,
    "op12_importance": importance.op12_importance,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLES = {
    "op2_substring_dedup": anchors.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op5_suffix_dedup": suffixes.ORACLE,
    "op6_topk": vafile.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_decontaminate": leaks.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
