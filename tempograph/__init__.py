"""A PySpark-native engine for bitemporal property graphs."""
