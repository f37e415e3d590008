"""The driver contract's entries of this subpackage: query name -> function, and SQL where it can say the same."""

from __future__ import annotations

from gleaner.llm import compression, exact, hnsw, language, minhash, mixing, packing, substring, tokenfile, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_embedding_near_dedup": hnsw.op2,
    "op3_source_mixing": mixing.op3,
    "op4_minhash_near_dedup": minhash.op4,
    "op5_exact_dedup": exact.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_substring_dedup": substring.op7,
    "op8_compression_quality": compression.op8,
    "op9_language_id": language.op9,
    "op10_token_file": tokenfile.op10,
}
SQL = {"op5_exact_dedup": exact.OP5_SQL}
