"""A PySpark-native analytics engine for company research: pure DataFrame operators."""
