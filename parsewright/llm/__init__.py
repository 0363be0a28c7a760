"""Operators for preparing training data: counting, packing, filtering, matching and formatting of texts."""
