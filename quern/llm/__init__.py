"""Operators for large training corpora: deduplication, mixing, quality, packing and archives."""
