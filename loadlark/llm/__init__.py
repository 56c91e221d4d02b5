"""Training-data operators: filters, dedup, packing, sharding and token files.

Nothing else in :mod:`loadlark` imports this subpackage.
"""
