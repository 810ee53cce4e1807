"""Training-data operators: cleaning, deduplication, tokenisation and scoring of large text tables.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
