"""A PySpark-native analytics engine for industrial network security data."""
