"""Functions of the corpus-graph engine."""
