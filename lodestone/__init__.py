"""Lodestone: a PySpark-native engine for scored, span-addressed text records."""
