"""Operators of a training-data pipeline: dedup, mixing, packing, tokens, quality, licences, vectors."""
