"""Warnings and errors of the raster engine."""


class RasterError(Exception):
    """Base class of the engine's errors."""


class IncompatibleOptions(RasterError):
    """Options that contradict each other."""


class IncompatibleBlockSize(RasterError):
    """A block size that does not fit the raster."""


class CodecUnavailable(RasterError):
    """The compression is known, but there is no codec for it here."""


class NodataAlphaMaskWarning(UserWarning):
    """A raster has nodata besides an alpha band or mask; nodata wins."""


class LossyCompression(UserWarning):
    """The compression changes values."""
