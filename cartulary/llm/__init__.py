"""Operators of a training-data pipeline: packing, archives, tokens, duplicates, quality and sharding."""
