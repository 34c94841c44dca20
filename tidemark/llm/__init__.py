"""Operators of a training-data pipeline: search, dedup, scans, packing, token files, tokenizers."""
