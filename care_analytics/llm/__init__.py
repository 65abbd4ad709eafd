"""Training-data operators: one module per operator, one registry of queries.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
