"""Spark-first analytics over rasters, cubes, features and points in space and time."""
