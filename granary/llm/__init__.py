"""Operators for preparing text corpora: filtering, deduplication, tokens, extraction, archives."""
