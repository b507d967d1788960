"""Corpus operations for training data: one module an operator, their queries in queries.py."""
