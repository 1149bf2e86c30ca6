"""tidemark: a PySpark-native analytics engine for geospatial object surveys."""
