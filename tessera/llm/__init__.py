"""Operators of a training-data pipeline over a table of documents.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
