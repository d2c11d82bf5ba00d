"""Stratafold: a PySpark engine for large file inventories and text corpora."""
