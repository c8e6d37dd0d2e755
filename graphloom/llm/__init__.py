"""Operators for large text corpora: formatting, deduplication, filtering, mixing, tokenising."""
