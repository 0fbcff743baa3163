"""Lodestar: a PySpark-native analytics engine for business-prospect intelligence."""
