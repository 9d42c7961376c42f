"""Training-data operators: sharding, packing, dedup, classifiers, mixing.

Nothing else in the library imports this subpackage.
"""
