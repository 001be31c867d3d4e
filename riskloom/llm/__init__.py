"""Operators for large text corpora, their registered queries and their SQL."""
