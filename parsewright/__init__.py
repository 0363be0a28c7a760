"""Preparation of parsed parallel corpora and tree-to-string model training on Spark."""
