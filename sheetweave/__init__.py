"""Sheetweave: a PySpark-native analytics engine for typed property graphs drawn over many sheets."""
