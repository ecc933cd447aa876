"""tessera: a PySpark-native batch analytics engine for text-rich records."""
