"""Streaming of the corpus-graph engine."""
