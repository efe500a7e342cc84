"""Operators for training-data pipelines: token counts, packing, deduplication, retrieval, media, filters.

Nothing outside this package imports it; the registry of its queries is :mod:`tidemark.llm.registry`.
"""
