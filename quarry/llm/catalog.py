"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embedding_groups, lines, negatives, ogg, packing, quality, simhash, substrings, token_files, toxicity, vector_codes, warc

QUERIES = {
    "op1_quality_mcd": quality.query,
    "op2_simhash_popcount": simhash.query,
    "op3_toxicity_mil": toxicity.query,
    "op4_substring_doubling": substrings.query,
    "op5_bpe_backtracking": bpe.query,
    "op6_line_dedup": lines.query,
    "op7_ogg_media": ogg.query,
    "op8_token_files": token_files.query,
    "op9_warc_derivatives": warc.query,
    "op10_best_fit_packing": packing.query,
    "op11_voronoi_negatives": negatives.query,
    "op12_vafile_codes": vector_codes.query,
    "op13_cosine_groups": embedding_groups.query,
}

ORACLE = {
    "op1_quality_mcd": quality.oracle(),
    "op4_substring_doubling": substrings.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op11_voronoi_negatives": negatives.ORACLE,
    "op12_vafile_codes": vector_codes.ORACLE,
    "op13_cosine_groups": embedding_groups.ORACLE,
}
