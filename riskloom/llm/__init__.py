"""Operators and queries for building training corpora. Nothing outside this package imports it."""
