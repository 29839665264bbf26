"""Training-data operators: tokens, near and exact deduplication, sharding, language, decontamination, packing.

Each operator is ``DataFrame -> DataFrame`` and names the columns it reads, so extra
columns of the input never clash with its own.  ``queries`` registers one query per
operator; ``corpus_pipeline.py`` at the top of the repository chains five of them.
"""
