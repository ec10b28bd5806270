"""Spark-native retrieval analytics: chunking, BM25, fusion, reranking, evaluation and validation as DataFrame plans."""
