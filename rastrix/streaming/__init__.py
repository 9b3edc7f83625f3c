"""Windowed aggregates over event streams."""
