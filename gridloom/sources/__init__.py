"""The sources of the raster engine."""
