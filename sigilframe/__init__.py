"""Spark-native analytics over document notation: layout, definitions, symbols, library."""
