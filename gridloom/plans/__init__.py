"""The plans of the raster engine."""
