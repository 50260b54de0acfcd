"""Align, normalise and compare large collections of grids, profiles and descriptors on Spark."""
