"""tarn: a PySpark-native engine for code/text search, conversation analytics and corpus preparation."""

__version__ = "0.1.0"
