"""Harvest: a PySpark-native engine for collecting, cleaning and querying postings."""
