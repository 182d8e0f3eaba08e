"""Spark-native page, book and raster analytics."""

__version__ = "0.1.0"
