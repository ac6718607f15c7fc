"""Operators of a training-data pipeline: text cleaning, deduplication, search, packing, scoring.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
