"""The queries of this subpackage."""

from harborlight.llm import op01_token_counts, op02_byte_bpe, op03_token_files, op04_toxicity_chain, op05_url_filters, op06_ngram_jaccard, op07_best_fit_packing, op08_avi_mjpeg, op09_embedding_dedup, op10_quality_nbsvm, op11_nn_descent, op12_chebyshev_whitening, op13_conversation_repair

_MODULES = [op01_token_counts, op02_byte_bpe, op03_token_files, op04_toxicity_chain, op05_url_filters, op06_ngram_jaccard, op07_best_fit_packing, op08_avi_mjpeg, op09_embedding_dedup, op10_quality_nbsvm, op11_nn_descent, op12_chebyshev_whitening, op13_conversation_repair]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
