"""Sources of the corpus-graph engine."""
