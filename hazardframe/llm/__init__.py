"""Training-data operators: quality, toxicity, personal data, duplicates, contamination, mixing and binary output.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
