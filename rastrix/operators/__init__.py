"""Operators on coverages, cubes, features and point patterns; all take and return DataFrames."""
