"""Operators of a training-data pipeline: near-duplicates, licences, BPE, quality
rules, toxicity, language ID, packing, embedding near-duplicates, sharding and
token counts.  Nothing outside this subpackage imports it except the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
