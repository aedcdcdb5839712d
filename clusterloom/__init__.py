"""Similarity-graph clustering of embedding vectors, as DataFrame operations."""
