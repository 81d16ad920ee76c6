"""PySpark-native analytics over media and document catalogs."""
