"""Rollout scoring and trajectory data on Spark DataFrames."""

__version__ = "0.1.0"
