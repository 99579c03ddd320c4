"""Operators for training-data pipelines (see README, section "Training-data operators").

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
