"""shirabe: a PySpark-native engine for evidence-first auditing of web pages."""

__version__ = "0.1.0"
