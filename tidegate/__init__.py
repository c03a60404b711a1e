"""tidegate: a PySpark-native engine for content inspection and corpus preparation."""

__version__ = "0.1.0"
