"""loomtrace: a Spark-native engine for source-linked text analytics."""

__version__ = "0.1.0"
