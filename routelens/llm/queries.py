"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_tree, dart_minhash, differenced_shards, hilbert_packing, line_suffix_array, lz_fingerprint, merge_suffix_array, progressive_jpeg, pu_quality, string_kernel, turn_repair, vector_codes, wrapper_induction

QUERIES = {
    "op10_merge_suffix_array": merge_suffix_array.query,
    "op8_dart_minhash": dart_minhash.query,
    "op9_line_suffix_array": line_suffix_array.query,
    "op1_wrapper_induction": wrapper_induction.query,
    "op3_string_kernel": string_kernel.query,
    "op6_pu_quality": pu_quality.query,
    "op7_progressive_jpeg": progressive_jpeg.query,
    "op2_lz_fingerprint": lz_fingerprint.query,
    "op4_hilbert_packing": hilbert_packing.query,
    "op5_bpe_tree": bpe_tree.query,
    "op11_differenced_shards": differenced_shards.query,
    "op12_turn_repair": turn_repair.query,
    "op13_vector_codes": vector_codes.query,
}
ORACLES: dict[str, str] = {
    "op9_line_suffix_array": line_suffix_array.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
