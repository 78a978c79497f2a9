"""Queries of the operators in this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from tallyloom.llm import alignment, centroids, embeddings, extraction, fingerprint, minhash, mixing, packing, reputation, substrings, token_counts, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_embedding_dedup": embeddings.op2_embedding_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_minhash_dedup": minhash.op4_minhash_dedup,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_html_extraction": extraction.op7_html_extraction,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filter": reputation.op9_url_filter,
    "op10_warc": warc.op10_warc,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLES = {
    "op2_embedding_dedup": embeddings.OP2_SQL,
    "op4_minhash_dedup": minhash.OP4_SQL,
    "op9_url_filter": reputation.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
