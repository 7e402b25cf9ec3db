"""PySpark-native analytics for event streams and the files they are written to."""
