"""Operators for large text and vector corpora: extraction, filtering, deduplication, tokenization and packing."""
