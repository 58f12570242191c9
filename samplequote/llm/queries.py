"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (bpe_codec, crf_toxicity, exact_dedup, hard_negatives, knn_quality, link_filter, merkle, mixture_packing, near_dedup,
               packing, set_hash, sharding, token_counts)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_link_filter": link_filter.op3_link_filter,
    "op4_extendible_shards": sharding.op4_extendible_shards,
    "op5_near_duplicates": near_dedup.op5_near_duplicates,
    "op6_multiset_fingerprints": set_hash.op6_multiset_fingerprints,
    "op7_crf_toxicity": crf_toxicity.op7_crf_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_knn_quality": knn_quality.op9_knn_quality,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_mixture_packing": mixture_packing.op12_mixture_packing,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.op1_sql(),
    "op4_extendible_shards": sharding.op4_sql(),
    "op11_merkle_manifest": merkle.op11_sql(),
    "op13_hard_negatives": hard_negatives.op13_sql(),
}
