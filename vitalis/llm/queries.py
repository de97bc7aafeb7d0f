"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from vitalis.llm import oracles
from vitalis.llm.divergence import op12_source_divergence
from vitalis.llm.embeddings import op6_embedding_near_dedup
from vitalis.llm.fingerprints import op2_improbable_features
from vitalis.llm.language_model import op11_language_model
from vitalis.llm.lines import op3_line_dedup
from vitalis.llm.matrices import op10_token_matrices
from vitalis.llm.minhash import op4_minhash_near_dedup
from vitalis.llm.packing import op9_retrieval_packing
from vitalis.llm.pieces import op7_sentencepiece
from vitalis.llm.spelling import op13_spelling_variants
from vitalis.llm.substrings import op1_substring_dedup
from vitalis.llm.tokens import op8_token_counts
from vitalis.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_improbable_features": op2_improbable_features,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_retrieval_packing": op9_retrieval_packing,
    "op10_token_matrices": op10_token_matrices,
    "op11_language_model": op11_language_model,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {
    "op1_substring_dedup": oracles.OP1,
    "op4_minhash_near_dedup": oracles.OP4,
    "op6_embedding_near_dedup": oracles.OP6,
    "op12_source_divergence": oracles.OP12,
    "op13_spelling_variants": oracles.OP13,
}
