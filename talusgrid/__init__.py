"""A Spark-native engine for raster terrain and drainage-network analytics."""
