"""Spatial points, sensor time series and trajectories as Spark DataFrames."""

__version__ = "0.1.0"
