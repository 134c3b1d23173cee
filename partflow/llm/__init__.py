"""Operators for preparing training text at scale: deduplication, filtering, counting, mixing and packing."""
