"""quarry: a PySpark-native catalog search, catalog sync and corpus engine."""
