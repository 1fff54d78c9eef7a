"""graphloom: PySpark-native engine for schema-described exchange files and typed graph tables."""

__version__ = "0.1.0"
