"""Spark-native exploratory analysis of text, image, spectral, point-cloud and video data."""

__version__ = "0.1.0"
