"""A Spark-native corpus-graph engine: documents to a queryable knowledge graph.

Every stage is a DataFrame-to-DataFrame function over the tables of ``schemas``.
"""
__version__ = "0.1.0"
