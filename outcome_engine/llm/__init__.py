"""Operators for preparing training text: packing, deduplication, filters, tokens and extraction."""
