"""A PySpark-native engine for rule-driven extraction from web documents."""

__version__ = "0.1.0"
