"""Output profiles: named sets of creation options."""

from __future__ import annotations

import warnings
from collections import UserDict

#: name: (compression, photometric, whether readers may lack the codec)
_KINDS = {
    "jpeg": ("JPEG", "YCbCr", False),
    "webp": ("WEBP", None, True),
    "zstd": ("ZSTD", None, True),
    "lzw": ("LZW", None, False),
    "deflate": ("DEFLATE", None, False),
    "packbits": ("PACKBITS", None, False),
    "lzma": ("LZMA", None, False),
    "lerc": ("LERC", None, True),
    "lerc_deflate": ("LERC_DEFLATE", None, True),
    "lerc_zstd": ("LERC_ZSTD", None, True),
    "raw": (None, None, False),
}

BLOCK = 512


def options_of(name: str) -> dict:
    """The creation options of one profile."""
    compress, photometric, _ = _KINDS[name]
    out: dict = {"driver": "GTiff", "interleave": "pixel", "tiled": True, "blockxsize": BLOCK, "blockysize": BLOCK}
    if compress:
        out["compress"] = compress
    if photometric:
        out["photometric"] = photometric
    return out


class Profiles(UserDict):
    """Profiles by name, whatever its case; what is handed out is a copy."""

    def __init__(self):
        super().__init__({name: options_of(name) for name in _KINDS})

    def get(self, key: str) -> dict:  # noqa: D102
        name = key.lower()
        if name not in self.data:
            raise KeyError(f"no profile named {key}")
        if _KINDS[name][2]:
            warnings.warn(f"Not every reader can decode {_KINDS[name][0]}.", stacklevel=2)
        return dict(self.data[name])


cog_profiles = Profiles()


def rows() -> list[tuple]:
    """The profiles as rows: name, compress, photometric, interleave, block size, non-standard."""
    return [(n, c, p, "pixel", BLOCK, odd) for n, (c, p, odd) in _KINDS.items()]
