"""The streaming of the raster engine."""
