"""The queries of the training-data operators with their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemill.llm import bpe, hard_negatives, html_text, language, mixing, near_dedup, neighbours, packing, pii, prefix_trie, quality, quotes, substring_dedup


def queries() -> dict:
    return {
        "op1_quotation_linking": quotes.op1_quotation_linking,
        "op1_quotation_roundtrip": quotes.op1_quotation_roundtrip,
        "op2_boosted_html_text": html_text.op2_boosted_html_text,
        "op3_odd_sketch_near_dedup": near_dedup.op3_odd_sketch_near_dedup,
        "op4_temperature_mixing": mixing.op4_temperature_mixing,
        "op5_line_frequency_quality": quality.op5_line_frequency_quality,
        "op5_line_frequency_spared": quality.op5_line_frequency_spared,
        "op6_semi_markov_pii": pii.op6_semi_markov_pii,
        "op7_compression_language": language.op7_compression_language,
        "op8_speculative_bpe": bpe.op8_speculative_bpe,
        "op9_rabin_karp_substring_dedup": substring_dedup.op9_rabin_karp_substring_dedup,
        "op10_vantage_point_neighbours": neighbours.op10_vantage_point_neighbours,
        "op11_coordinate_hard_negatives": hard_negatives.op11_coordinate_hard_negatives,
        "op12_least_squares_packing": packing.op12_least_squares_packing,
        "op13_radix_prefix_trie": prefix_trie.op13_radix_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotation_linking": quotes.OP1_SQL,
        "op1_quotation_roundtrip": quotes.ROUNDTRIP_SQL,
        "op4_temperature_mixing": mixing.OP4_SQL,
        "op5_line_frequency_quality": quality.OP5_SQL,
        "op5_line_frequency_spared": quality.OP5_SPARED_SQL,
        "op11_coordinate_hard_negatives": hard_negatives.OP11_SQL,
        "op13_radix_prefix_trie": prefix_trie.OP13_SQL,
    }
