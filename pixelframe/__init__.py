"""pixelframe: a PySpark-native image and raster engine."""
