"""The operators of the raster engine."""
