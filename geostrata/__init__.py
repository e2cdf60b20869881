"""Geostrata: panel, data-quality and spatial-econometric analytics on Spark DataFrames."""

__version__ = "0.1.0"
