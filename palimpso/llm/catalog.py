"""The thirteen training-data operators as queries, with SQL where SQL can express the result."""

from __future__ import annotations

from . import centroids, decontaminate, divergence, language_id, licenses, minhash, oracles, packing, quality, sharding, substring, token_counts, toxicity, urls

QUERIES = {
    "op1_separator_scan": token_counts.op1,
    "op2_hyperminhash": minhash.op2,
    "op3_quality_cascade": quality.op3,
    "op4_winnowing": decontaminate.op4,
    "op5_association_rules": urls.op5,
    "op6_counterfactual_toxicity": toxicity.op6,
    "op7_hilbert_packing": packing.op7,
    "op8_recompression": substring.op8,
    "op9_hyperdimensional_language": language_id.op9,
    "op10_external_shuffle": sharding.op10,
    "op11_partial_distance_clusters": centroids.op11,
    "op12_license_join": licenses.op12,
    "op13_divergence_tiles": divergence.op13,
}

#: None for the others: a tokenizer, mined or trained models, and random orders are beyond SQL.
ORACLES = {
    "op2_hyperminhash": oracles.OP2,
    "op3_quality_cascade": oracles.OP3,
    "op4_winnowing": oracles.OP4,
    "op8_recompression": oracles.OP8,
    "op11_partial_distance_clusters": oracles.OP11,
    "op12_license_join": oracles.OP12,
    "op13_divergence_tiles": oracles.OP13,
}
