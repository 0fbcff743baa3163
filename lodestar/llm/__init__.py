"""Training-data operators: scoring, packing, deduplication, token files, counts, sharding, language ID.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
