"""A PySpark-native text-cleaning and text-quality engine."""
