"""Planetary-site analytics on PySpark DataFrames: grids, rasters, point clouds, site scores, search and shared state."""
