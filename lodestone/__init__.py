"""Lodestone: a Spark-native evidence retrieval engine over page-structured document collections."""

__version__ = "0.1.0"
