"""Operators for preparing training data: filtering, deduplication, search, mixing,
sharding and packing of documents. Nothing else in the library imports this folder."""
