"""Operators for building training corpora out of web-scale text tables.

Nothing else in the library imports this subpackage; it is wired up only by
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
