"""Queries of this subpackage over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from asofkit.llm import block_labels, line_join, mixing, ngram_join, pair_counts, pattern_packing, phrases, progressive_jpeg, rule_ledger, separator_scan, snapshots, super_kmers, warc

QUERIES = {
    "op1_separator_scan": separator_scan.query,
    "op2_ngram_join": ngram_join.query,
    "op3_warc": warc.query,
    "op4_pattern_packing": pattern_packing.query,
    "op5_mixing": mixing.query,
    "op6_rule_ledger": rule_ledger.query,
    "op7_super_kmers": super_kmers.query,
    "op8_snapshots": snapshots.query,
    "op9_line_join": line_join.query,
    "op10_progressive_jpeg": progressive_jpeg.query,
    "op11_block_labels": block_labels.query,
    "op12_pair_counts": pair_counts.query,
    "op13_phrases": phrases.query,
}
ORACLES = {
    "op2_ngram_join": ngram_join.SQL,
    "op3_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
    "op6_rule_ledger": rule_ledger.SQL,
    "op7_super_kmers": super_kmers.SQL,
    "op8_snapshots": snapshots.SQL,
    "op13_phrases": phrases.SQL,
}
