"""The queries of this package by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import bpe_automaton, flac, grid_codes, language_id, licenses, lm_scoring, near_duplicates, ngram_join, packing, quality, sharding, substrings, whitening

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1,
    "op2_license_scan": licenses.op2,
    "op3_substring_dedup": substrings.op3,
    "op4_hyperminhash": near_duplicates.op4,
    "op5_bpe_automaton": bpe_automaton.op5,
    "op6_flac": flac.op6,
    "op7_language_id": language_id.op7,
    "op8_quality_rules": quality.op8,
    "op9_packing": packing.op9,
    "op10_sharding": sharding.op10,
    "op11_grid_codes": grid_codes.op11,
    "op12_ngram_join": ngram_join.op12,
    "op13_whitening": whitening.op13,
}

ORACLE_SQL = {
    "op2_license_scan": licenses.op2_sql(),
    "op11_grid_codes": grid_codes.op11_sql(),
    "op12_ngram_join": ngram_join.op12_sql(),
}
