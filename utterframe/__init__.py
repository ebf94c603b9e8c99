"""A PySpark-native engine for time-stamped word sequences and similar ordered data."""
