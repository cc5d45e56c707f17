"""Training-data operators: dedup, mixing, tokenizing, scoring and nearest neighbours.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
