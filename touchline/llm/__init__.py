"""Operators and queries for training-data corpora; nothing else in the package imports this folder."""
