"""Tessera: a PySpark-native knowledge-analytics engine."""
