"""Training-data operators: quality, dedup, scoring, tokens and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
