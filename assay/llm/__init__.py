"""Operators for building training corpora: search, formatting, packing, deduplication and filtering."""
