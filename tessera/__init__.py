"""tessera: a PySpark-native analytics library."""
