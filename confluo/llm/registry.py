"""The queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, line_dedup, near_dedup, periodic_runs, piece_bpe, quality, sharding, spelling, token_files, topk_search, warc_revisits

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_minhash_line_dedup": line_dedup.query,
    "op3_tensored_minhash_dedup": near_dedup.query,
    "op4_quadratic_discriminant_quality": quality.query,
    "op5_composite_text_density": html_text.query,
    "op6_kd_tree_top_k": topk_search.query,
    "op7_spaced_seed_decontamination": decontaminate.query,
    "op8_elias_fano_token_files": token_files.query,
    "op9_sampled_splitter_sharding": sharding.query,
    "op10_warc_revisit_resolution": warc_revisits.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_sentencepiece_bpe": piece_bpe.query,
    "op13_spelling_variants": spelling.query,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc_revisit_resolution": warc_revisits.SQL,
}
