"""Training-data operators: exact, line, substring and near-duplicate removal,
license scans, nearest neighbours, mixing, sharding, quality and tokenisation.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
