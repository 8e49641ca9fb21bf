"""PySpark-native panel analytics."""
