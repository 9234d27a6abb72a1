"""Spark-native analytics for tiled, multi-resolution raster data."""

__version__ = "0.1.0"
