"""Training-data operators: quality, privacy, secrets, mixing, filters and duplicates.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
