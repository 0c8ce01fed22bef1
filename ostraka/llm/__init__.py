"""Operators for preparing training text at scale: filters, deduplication, search, packing and tokenising."""
