"""Turnloom: a PySpark-native engine for multi-speaker conversation data."""
