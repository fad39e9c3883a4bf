"""A PySpark-native commerce analytics engine."""
