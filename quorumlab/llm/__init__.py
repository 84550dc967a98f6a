"""Operators of a training-data pipeline: quality, personal data, packing, tokens, neighbours.

Nothing outside this package, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
