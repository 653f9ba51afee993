"""Operators that prepare text corpora for model training. Nothing outside this package imports it."""
