"""The functions of the raster engine."""
