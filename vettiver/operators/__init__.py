"""Index tables, scoring, fusion, reranking, packing and evaluation as DataFrame operators."""
