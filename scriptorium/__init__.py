"""Scriptorium: a PySpark-native text analytics engine for multilingual and code-mixed documents."""

__version__ = "0.1.0"
