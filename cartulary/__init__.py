"""Schema-catalog analytics on Spark DataFrames.

Raw catalog extracts of many databases become snapshot tables keyed by
``(catalog_id, snapshot_id)``; every operator takes and returns DataFrames.
"""
