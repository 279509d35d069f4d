"""A PySpark-native engine for electronic business messages."""
