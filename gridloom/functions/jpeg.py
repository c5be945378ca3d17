"""Baseline JPEG in NumPy: encoding with Huffman codes of each image's own, decoding of sequential images.

Images are (height, width, 1 or 3) bytes.  With three samples and ``ycbcr`` the
image is kept as luma and chroma, without subsampling; decoding takes any
sampling.  Only the walk along the decoder's bit stream is a loop.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The format's example quantisation tables for quality 50, luma and chroma, row by row. Fixed values.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
QUALITY = 75
#: The order of an 8 x 8 block's places along its diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_k = np.arange(8)
#: The orthonormal cosine transform.
DCT = np.sqrt(np.where(_k[:, None] == 0, 1, 2) / 8) * np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16)
#: From red, green and blue to luma and chroma.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])


def quantisation(base: list[int], quality: int) -> np.ndarray:
    """A table at a quality from 1 to 100."""
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of at most 16 of a prefix code for the symbols that occur; no code is all ones."""
    heap = [(1, -1, (256,))] + [(int(n), int(s), (int(s),)) for s, n in enumerate(counts) if n]
    length = dict.fromkeys([x[1] for x in heap if x[1] >= 0], 0) | {256: 0}
    heapq.heapify(heap)
    if len(heap) == 1:
        return {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    per = [0] * (max(length.values()) + 2)
    for n in length.values():
        per[n] += 1
    for n in range(len(per) - 1, 16, -1):  # two of the longest move up: one to their parent, one beside a shorter one
        while per[n]:
            j = n - 2
            while not per[j]:
                j -= 1
            per[n] -= 2
            per[n - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    ordered = sorted((s for s in length if s != 256), key=lambda s: (length[s], s)) + [256]
    lengths = [n for n, m in enumerate(per) for _ in range(m)]
    return {s: n for s, n in zip(ordered, lengths) if s != 256}


def canonical(lengths: dict[int, int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """(symbols in order, (code, length) of each) of a code's lengths."""
    order, code, before, out = sorted(lengths, key=lambda s: (lengths[s], s)), 0, 0, {}
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        out[s] = code, before
        code += 1
    return order, out


def _bits_of(values: np.ndarray) -> np.ndarray:
    """How many bits a magnitude has."""
    return np.ceil(np.log2(np.abs(values).astype(np.float64) + 1)).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(x: np.ndarray, ycbcr: bool = False, quality: int = QUALITY) -> bytes:
    """A complete baseline image."""
    high, wide, n = x.shape
    if n not in (1, 3) or x.dtype != np.uint8:
        raise ValueError("JPEG takes one or three bands of bytes")
    y = x.astype(np.float64)
    if ycbcr and n == 3:
        y = y @ YCC.T + (0, 128, 128)
    y = np.pad(y, ((0, -high % 8), (0, -wide % 8), (0, 0)), mode="edge") - 128
    rows, cols = y.shape[0] // 8, y.shape[1] // 8
    blocks = y.reshape(rows, 8, cols, 8, n).transpose(0, 2, 4, 1, 3).reshape(-1, n, 8, 8)
    tables = [quantisation(LUMA, quality)] + [quantisation(CHROMA if ycbcr else LUMA, quality)] * (n - 1)
    levels = np.rint((DCT @ blocks @ DCT.T).reshape(-1, n, 64) / np.stack(tables)).astype(np.int64)[:, :, ZIGZAG]
    steps = np.diff(levels[:, :, 0], axis=0, prepend=0)
    flat = levels.reshape(-1, 64)
    block = np.arange(len(flat))
    # One item for each symbol: its block and place, the symbol, the bits after it and how many.
    size = _bits_of(steps.reshape(-1))
    items = [(block * 512, size, steps.reshape(-1), size, np.ones(len(block), dtype=bool))]
    at, place = np.nonzero(flat[:, 1:])
    place = place + 1
    value = flat[at, place]
    first = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, dtype=bool)
    gap = place - np.where(first, 0, np.append(0, place[:-1])) - 1 if len(at) else place
    size = _bits_of(value)
    items.append((at * 512 + place * 8 + 4, gap % 16 * 16 + size, value, size, np.zeros(len(at), dtype=bool)))
    for more in range(3):  # runs of sixteen zeros
        long = np.flatnonzero(gap // 16 > more)
        items.append((at[long] * 512 + place[long] * 8 + more, np.full(len(long), 0xF0), np.zeros_like(long), np.zeros_like(long), np.zeros(len(long), dtype=bool)))
    last = np.zeros(len(flat), dtype=np.int64)
    np.maximum.at(last, at, place)
    short = np.flatnonzero(last < 63)
    items.append((short * 512 + 511, np.zeros_like(short), np.zeros_like(short), np.zeros_like(short), np.zeros(len(short), dtype=bool)))
    key, symbol, value, size, dc = (np.concatenate(c) for c in zip(*items))
    order = np.argsort(key)
    key, symbol, value, size, dc = (c[order] for c in (key, symbol, value, size, dc))
    group = (key // 512 % n > 0).astype(np.int64) * 2 + ~dc  # luma and chroma have codes of their own
    codes, length, body = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64), b""
    for g in range(4 if n > 1 else 2):
        here = group == g
        symbols, table = canonical(code_lengths(np.bincount(symbol[here], minlength=256)))
        look = np.array([table.get(s, (0, 0)) for s in range(256)])
        codes[here], length[here] = look[symbol[here]].T
        counts = np.bincount([table[s][1] for s in symbols], minlength=17)[1:17] if symbols else np.zeros(16, dtype=int)
        body += _segment(0xC4, bytes([(g % 2) << 4 | g // 2]) + bytes(counts.tolist()) + bytes(symbols))
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    word, total = codes << size | bits, length + size
    ends = np.cumsum(total)
    item = np.repeat(np.arange(len(word)), total)
    shift = ends[item] - 1 - np.arange(len(item))
    stream = np.packbits(np.append((word[item] >> shift & 1).astype(np.uint8), np.ones(-len(item) % 8, dtype=np.uint8))).tobytes()
    chroma = int(n > 1)
    head = b"".join(_segment(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].tolist())) for i in range(1 + chroma))
    head += _segment(0xC0, struct.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(n)))
    scan = _segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + b"\x00\x3f\x00")
    return b"\xff\xd8" + head + body + scan + stream.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


class Tables:
    """What an image's, or an abbreviated table stream's, header says."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, np.ndarray] = {}
        self.frame: tuple | None = None
        self.restart = 0

    def read(self, data: bytes) -> tuple[bytes, list[tuple[int, int]]] | None:
        """Take in all segments up to the scan; gives the scan's bytes and (component, tables) if there is one."""
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("not a JPEG segment")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                return None
            body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
            at += 4 + len(body)
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    table = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8)
                    self.quant[body[0] & 15] = table.astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    self.codes[body[0]] = lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                precision, high, wide, n = struct.unpack(">BHHB", body[:6])
                if precision != 8:
                    raise ValueError("only JPEG of eight bits is decoded")
                self.frame = high, wide, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only sequential JPEG is decoded")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                return data[at:], [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        return None


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits that may follow, the symbol and, times 256, its code's length."""
    table, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
            code += 1
        k += n
        code <<= 1
    return table


def decode(data: bytes, ycbcr: bool = False, tables: bytes | None = None) -> np.ndarray:
    """The image (height, width, samples) of a sequential JPEG; ``tables`` is a stream of tables that it may leave out."""
    t = Tables()
    if tables:
        t.read(tables)
    scan, chosen = t.read(data) or (None, None)
    if scan is None or t.frame is None:
        raise ValueError("a JPEG without an image")
    high, wide, parts = t.frame
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    single = len(parts) == 1
    if single:  # blocks of one component are not grouped
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
        across, down = -(-wide // 8), -(-high // 8)
    by_id = dict(chosen)
    planes = [np.zeros((down * p[2], across * p[1], 64), dtype=np.int64) for p in parts]
    plan = [(i, v, h, t.codes[by_id[p[0]] >> 4].tolist(), t.codes[0x10 | by_id[p[0]] & 15].tolist()) for i, p in enumerate(parts) for v in range(p[2]) for h in range(p[1])]
    pieces = _restarts(scan)
    unit, piece, at, buffer, before = 0, -1, 0, b"", [0] * len(parts)
    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    zig = ZIGZAG.tolist()
    for my in range(down):
        for mx in range(across):
            if unit == 0 or (t.restart and unit % t.restart == 0):
                piece += 1
                buffer, at, before = (pieces[piece] if piece < len(pieces) else b"") + b"\xff" * 8, 0, [0] * len(parts)
            unit += 1
            for i, v, h, dc, ac in plan:
                _, sv, sh = 0, parts[i][2], parts[i][1]
                base = ((my * sv + v) * (across * sh) + mx * sh + h) * 64
                k, table, out = 0, dc, found[i]
                while k < 64:
                    b = at >> 3
                    if b + 5 > len(buffer):
                        raise ValueError("a JPEG that ends too early")
                    bits = int.from_bytes(buffer[b : b + 5], "big")
                    entry = table[bits >> (24 - (at & 7)) & 0xFFFF]
                    length, symbol = entry >> 8, entry & 255
                    if not length:
                        raise ValueError("a JPEG with a code that it does not define")
                    size = symbol & 15
                    value = 0
                    if size:
                        value = bits >> (40 - (at & 7) - length - size) & ((1 << size) - 1)
                        if value < 1 << (size - 1):
                            value -= (1 << size) - 1
                    at += length + size
                    if k == 0:
                        before[i] += value
                        if before[i]:
                            out.append((base, before[i]))
                        k, table = 1, ac
                        continue
                    if not size:
                        if symbol != 0xF0:
                            break
                        k += 16
                        continue
                    k += symbol >> 4
                    if k > 63:
                        raise ValueError("a JPEG with too many coefficients")
                    out.append((base + zig[k], value))
                    k += 1
    out = []
    for plane, p, some in zip(planes, parts, found):
        if some:
            where, value = np.array(some, dtype=np.int64).T
            plane.reshape(-1)[where] = value
        q = np.zeros(64, dtype=np.int64)
        q[ZIGZAG] = t.quant[p[3]]
        x = DCT.T @ (plane * q).reshape(*plane.shape[:2], 8, 8).astype(np.float64) @ DCT + 128
        x = x.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, -1)
        out.append(np.repeat(np.repeat(x, most_v // p[2], axis=0), most_h // p[1], axis=1)[:high, :wide])
    y = np.stack(out, axis=-1)
    if ycbcr and y.shape[2] == 3:
        y = (y - (0, 128, 128)) @ np.linalg.inv(YCC).T
    return np.clip(np.rint(y), 0, 255).astype(np.uint8)


def _restarts(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffing."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        marker = scan[at + 1]
        if marker == 0 or marker == 0xFF:
            at += 2 if marker == 0 else 1
            continue
        out.append(scan[start:at])
        if not 0xD0 <= marker <= 0xD7:
            return [x.replace(b"\xff\x00", b"\xff") for x in out]
        at += 2
        start = at
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, scan[start:]]]
