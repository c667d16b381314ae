"""A PySpark-native engine for vector quantization and nearest-neighbour analytics."""
