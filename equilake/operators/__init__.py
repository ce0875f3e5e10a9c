"""Reusable relational operators: as-of joins, windows, ranks, upserts."""
