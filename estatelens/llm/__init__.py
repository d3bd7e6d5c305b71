"""Operators for text corpora: filtering, deduplication, mixing, packing, encoding, search and archives."""
