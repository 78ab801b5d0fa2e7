"""A PySpark-native analytics engine for catalogue and training data."""
