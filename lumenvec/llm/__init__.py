"""Operators for preparing training text at large scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
