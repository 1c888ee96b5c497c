"""Operators for training-data corpora, and their queries. Nothing else in the library imports this subpackage."""
