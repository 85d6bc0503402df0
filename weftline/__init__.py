"""Weftline: a PySpark-native engine for record mapping, validation and delivery analytics."""
