"""Names of the corpus queries and their SQL."""

from __future__ import annotations

from . import infill, lengths, lexical, mixing, neighbours, packing, private, quality, reshard, simhash, substrings, tokenfiles, warc

QUERIES = {
    "op1_simhash_pigeonring": simhash.query,
    "op2_token_files": tokenfiles.query,
    "op3_nn_descent": neighbours.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality.query,
    "op6_fixed_block_anchors": substrings.query,
    "op7_token_lengths": lengths.query,
    "op8_warc_index": warc.query,
    "op9_reshard_flow": reshard.query,
    "op10_mix_sources": mixing.query,
    "op11_block_max": lexical.query,
    "op12_infill_units": infill.query,
    "op13_private_anchors": private.query,
}

ORACLES = {
    "op5_quality_rules": quality.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_block_max": lexical.ORACLE,
    "op12_infill_units": infill.ORACLE,
}
