"""Training-data operators: cleaning, deduplication, formatting, tokenising and sharding of text corpora.

Nothing outside this package imports it.
"""
