"""Operators for text corpora: duplicates, scoring, archives, filters, formats and mixing."""
