"""The queries of the ten operators, by name."""

from matrixloom.llm import bpe, elias_fano, exact_dedup, html_text, language_id, multi_index, packing, quality, sharding, simhash

QUERIES = {
    "op1_inverted_multi_index": multi_index.op1_inverted_multi_index,
    "op2_language_id": language_id.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_ranking": quality.op4_quality_ranking,
    "op5_elias_fano_ids": elias_fano.op5_elias_fano_ids,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op7_sum_of_squares_packing": packing.op7_sum_of_squares_packing,
    "op8_rendezvous_shards": sharding.op8_rendezvous_shards,
    "op9_site_templates": html_text.op9_site_templates,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.SQL}
