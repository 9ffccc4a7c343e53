"""Operators of the corpus-graph engine."""
