"""Block compressions of the TIFF format."""

from __future__ import annotations

import lzma
import zlib

import numpy as np

from gridloom.errors import CodecUnavailable

#: TIFF compression tag values.
TAGS = {None: 1, "LZW": 5, "JPEG": 7, "DEFLATE": 8, "ADOBE_DEFLATE": 32946, "PACKBITS": 32773, "LZMA": 34925, "ZSTD": 50000, "WEBP": 50001, "LERC": 34887, "LERC_DEFLATE": 34887, "LERC_ZSTD": 34887}
NAMES = {1: None, 5: "LZW", 7: "JPEG", 8: "DEFLATE", 32946: "DEFLATE", 32773: "PACKBITS", 34925: "LZMA", 50000: "ZSTD", 50001: "WEBP", 34887: "LERC"}


def compress(data: bytes, name: str | None) -> bytes:
    match (name or "").upper():
        case "" | "NONE":
            return data
        case "DEFLATE" | "ADOBE_DEFLATE":
            return zlib.compress(data, 6)
        case "LZMA":
            return lzma.compress(data)
        case "ZSTD":
            import zstandard

            return zstandard.ZstdCompressor(level=9).compress(data)
        case "PACKBITS":
            return packbits(data)
        case "LZW":
            return lzw(data)
        case "JPEG":
            raise CodecUnavailable("JPEG takes images, not bytes alone; see functions.jpeg")
    raise CodecUnavailable(f"no codec for {name} is installed")


def decompress(data: bytes, name: str | None, size: int) -> bytes:
    """The block of ``size`` bytes."""
    match (name or "").upper():
        case "" | "NONE":
            return data
        case "DEFLATE" | "ADOBE_DEFLATE":
            return zlib.decompress(data)
        case "LZMA":
            return lzma.decompress(data)
        case "ZSTD":
            import zstandard

            return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        case "PACKBITS":
            return unpackbits(data)
        case "LZW":
            return unlzw(data)
    raise CodecUnavailable(f"no codec for {name} is installed")


def packbits(data: bytes) -> bytes:
    """Run lengths: runs of three and more equal bytes, literals between."""
    out, n, i, start = bytearray(), len(data), 0, 0

    def literals(upto: int) -> None:
        at = start
        while at < upto:
            k = min(128, upto - at)
            out.append(k - 1)
            out.extend(data[at : at + k])
            at += k

    x = np.frombuffer(data, dtype=np.uint8)
    ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, n) if n else np.zeros(0, dtype=int)
    for end in ends.tolist():
        if end - i >= 3:
            literals(i)
            run, byte = end - i, data[i]
            while run:
                k = min(128, run)
                out.extend((257 - k if k > 1 else 0, byte))
                run -= k
            start = end
        i = end
    literals(n)
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        i += 1
        if k < 128:
            out.extend(data[i : i + k + 1])
            i += k + 1
        elif k > 128:
            out.extend(data[i : i + 1] * (257 - k))
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one early."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    table, width, w = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, width)
    following = 258
    for byte in data:
        wider = w + bytes((byte,))
        if wider in table:
            w = wider
            continue
        put(table[w], width)
        table[wider] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, width, following = {bytes((i,)): i for i in range(256)}, 9, 258
        elif following in (512, 1024, 2048):
            width += 1
        w = bytes((byte,))
    if w:
        put(table[w], width)
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257, width)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last: bytes | None = None
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        out += entry
        last = entry
    return bytes(out)


def undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """Values of a (rows, columns, samples) block stored as differences."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, cols, samples = block.shape
        size = block.dtype.itemsize
        raw = np.cumsum(np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(block.dtype.newbyteorder(">")).astype(block.dtype).reshape(rows, cols, samples)
    return block


def apply_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    """Horizontal differences of a (rows, columns, samples) block."""
    if predictor == 2:
        out = block.copy()
        out[:, 1:] = block[:, 1:] - block[:, :-1]
        return out
    return block
