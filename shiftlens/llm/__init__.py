"""Operators over text corpora: scoring, near duplicates, search, filters, mixing and packing."""
