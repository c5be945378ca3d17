"""TIFF files: headers, blocks and the layout of cloud-optimized files.

Classic and Big TIFF, both byte orders, strips and tiles, pixel and band
interleaving.  Nothing here needs Spark; the data sources call it on executors.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

from gridloom.functions import codecs, jpeg

#: Field type: (struct letter, bytes).
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}

GHOST_KEY = "GDAL_STRUCTURAL_METADATA_SIZE="


class NotTiff(ValueError):
    """The bytes are not a TIFF file."""


@dataclass
class Directory:
    """One image file directory."""

    offset: int
    tags: dict[int, tuple]
    order: str

    def get(self, tag: int, default=None):
        value = self.tags.get(tag)
        return default if value is None else value[0] if isinstance(value, tuple) and len(value) == 1 else value

    def many(self, tag: int) -> tuple:
        value = self.tags.get(tag, ())
        return value if isinstance(value, tuple) else (value,)

    @property
    def width(self) -> int:
        return self.get(256)

    @property
    def height(self) -> int:
        return self.get(257)

    @property
    def samples(self) -> int:
        return self.get(277, 1)

    @property
    def tiled(self) -> bool:
        return 322 in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """(height, width) of a block."""
        if self.tiled:
            return self.get(323), self.get(322)
        return min(self.get(278, self.height), self.height), self.width

    @property
    def separate(self) -> bool:
        return self.get(284, 1) == 2

    @property
    def compression(self) -> str | None:
        return codecs.NAMES.get(self.get(259, 1), str(self.get(259)))

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.many(258) or (1,), self.many(339) or (1,)
        if bits[0] < 8:
            return np.dtype("u1")
        return np.dtype(f"{self.order}{_KINDS.get(kind[0], 'u')}{bits[0] // 8}")

    @property
    def is_mask(self) -> bool:
        return bool(self.get(254, 0) & 4)

    @property
    def grid(self) -> tuple[int, int]:
        """(rows, columns) of blocks."""
        bh, bw = self.block
        return -(-self.height // bh), -(-self.width // bw)

    def blocks(self) -> list[tuple[int, int, int, int, int]]:
        """(band or 0 for all, block row, block column, offset, byte count) of every block."""
        offsets = self.many(324) or self.many(273)
        counts = self.many(325) or self.many(279)
        rows, cols = self.grid
        planes = self.samples if self.separate else 1
        out = []
        for i, (o, c) in enumerate(zip(offsets, counts)):
            plane, rest = divmod(i, rows * cols)
            if plane < planes:
                out.append((plane + 1 if self.separate else 0, rest // cols, rest % cols, o, c))
        return out

    @property
    def nodata(self) -> float | None:
        text = self.get(42113)
        try:
            return float(text) if text else None
        except ValueError:
            return None

    @property
    def transform(self) -> tuple[float, ...]:
        """The affine coefficients a, b, c, d, e, f."""
        if m := self.tags.get(34264):
            return m[0], m[1], m[3], m[4], m[5], m[7]
        scale, tie = self.tags.get(33550), self.tags.get(33922)
        if scale and tie and len(tie) == 6:
            return scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]
        return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0

    @property
    def gcps(self) -> list[tuple[float, float, float, float, float]]:
        """Ground control points (row, column, x, y, z)."""
        tie = self.tags.get(33922, ())
        if len(tie) <= 6 or 33550 in self.tags:
            return []
        return [(tie[i + 1], tie[i], *tie[i + 3 : i + 6]) for i in range(0, len(tie) - 5, 6)]

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(34735, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = found.get(3072) or found.get(2048)
        return code if code and code < 32767 else None

    def metadata(self) -> dict:
        """Dataset tags by namespace ("" the default), and by band: tags, description, scale, offset."""
        out: dict = {"dataset": {}, "bands": {}}
        text = self.get(42112)
        if not text:
            return out
        for item in ElementTree.fromstring(text):
            name, sample, role = item.get("name"), item.get("sample"), item.get("role")
            if sample is None:
                out["dataset"].setdefault(item.get("domain", ""), {})[name] = item.text or ""
            else:
                band = out["bands"].setdefault(int(sample) + 1, {"tags": {}})
                if role in ("description", "scale", "offset"):
                    band[role] = item.text if role == "description" else float(item.text)
                else:
                    band["tags"][name] = item.text or ""
        return out

    def colorinterp(self) -> list[str]:
        photometric, extra, n = self.get(262, 1), self.many(338), self.samples
        base = {2: ["red", "green", "blue"], 6: ["red", "green", "blue"], 3: ["palette"]}.get(photometric, ["gray"])
        out = [*base, *["undefined"] * n][:n]
        for i, kind in enumerate(extra):
            at = n - len(extra) + i
            if kind in (1, 2) and 0 <= at < n:
                out[at] = "alpha"
        return out

    def colormap(self) -> dict[int, tuple[int, int, int, int]] | None:
        table = self.tags.get(320)
        if not table:
            return None
        n = len(table) // 3
        return {i: (table[i] >> 8, table[n + i] >> 8, table[2 * n + i] >> 8, 255) for i in range(n)}


@dataclass
class TiffFile:
    """A parsed file: its directories, and the masks among them, in file order."""

    order: str
    big: bool
    directories: list[Directory] = field(default_factory=list)
    masks: list[Directory] = field(default_factory=list)
    external: list[Directory] = field(default_factory=list)
    ghost: dict[str, str] = field(default_factory=dict)

    @property
    def decimations(self) -> list[int]:
        """The rounded ratio of the full width to each overview's."""
        main = self.directories[0]
        return [round(main.width / d.width) for d in self.directories[1:]]


def parse(read) -> TiffFile:
    """The headers of a file; ``read(offset, size)`` gives bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise NotTiff("no TIFF signature")
    big = version == 43
    out = TiffFile(order, big)
    start = 16 if big else 8
    text = read(start, 64)
    if text.startswith(GHOST_KEY.encode()):
        size = int(text[len(GHOST_KEY) :].split(b" ")[0])
        line = text.index(b"\n") + 1
        body = read(start + line, size).decode("latin-1")
        out.ghost = dict(x.split("=", 1) for x in body.split("\n") if "=" in x)
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        directory, at = _directory(read, at, order, big)
        (out.masks if directory.is_mask else out.directories).append(directory)
    return out


def _directory(read, at: int, order: str, big: bool) -> tuple[Directory, int]:
    n_size, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, n_size))[0]
    raw = read(at + n_size, n * entry + struct.calcsize(word))
    tags = {}
    for i in range(n):
        e = raw[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(f"{order}HH", e[:4])
        count = struct.unpack(f"{order}{word}", e[4 : 4 + struct.calcsize(word)])[0]
        if kind not in _TYPES:
            continue
        letter, size = _TYPES[kind]
        value = e[4 + struct.calcsize(word) :]
        total = size * count
        data = value[:total] if total <= len(value) else read(struct.unpack(f"{order}{word}", value)[0], total)
        if letter == "s":
            tags[tag] = data.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else data
        elif len(letter) == 2:
            pairs = struct.unpack(f"{order}{letter * count}", data)
            tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2]))
        else:
            tags[tag] = struct.unpack(f"{order}{count}{letter}", data)
    following = struct.unpack(f"{order}{word}", raw[n * entry :])[0]
    return Directory(at, tags, order), following


def decode_block(d: Directory, row: int, data: bytes) -> np.ndarray:
    """A block's values as (height, width, samples in it); strips at the end may be lower."""
    bh, bw = d.block
    if not d.tiled:
        bh = min(bh, d.height - row * bh)
    samples = 1 if d.separate else d.samples
    bits = (d.many(258) or (1,))[0]
    if bits < 8:
        stride = -(-bw * samples * bits // 8)
        raw = np.frombuffer(codecs.decompress(data, d.compression, stride * bh), dtype=np.uint8)[: stride * bh].reshape(bh, stride)
        parts = np.unpackbits(raw, axis=1)[:, : bw * samples * bits].reshape(bh, bw * samples, bits)
        return (parts @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8).reshape(bh, bw, samples)
    if d.compression == "JPEG":
        return jpeg.decode(data, d.get(262, 1) == 6, bytes(d.many(347)) or None)[:bh, :bw]
    size = bh * bw * samples * d.dtype.itemsize
    raw = codecs.decompress(data, d.compression, size)[:size]
    predictor = d.get(317, 1)
    block = np.frombuffer(raw, dtype=d.dtype).reshape(bh, bw, samples)
    return codecs.undo_predictor(block.astype(d.dtype.newbyteorder("=")) if predictor != 3 else block, predictor)


#: Names in a satellite product's file of rational polynomials, and those of the RPC tags. Fixed values.
_RPC = {
    "ERRBIAS": "ERR_BIAS", "ERRRAND": "ERR_RAND", "LINEOFFSET": "LINE_OFF", "SAMPOFFSET": "SAMP_OFF", "LATOFFSET": "LAT_OFF", "LONGOFFSET": "LONG_OFF", "HEIGHTOFFSET": "HEIGHT_OFF",
    "LINESCALE": "LINE_SCALE", "SAMPSCALE": "SAMP_SCALE", "LATSCALE": "LAT_SCALE", "LONGSCALE": "LONG_SCALE", "HEIGHTSCALE": "HEIGHT_SCALE",
    "LINENUMCOEF": "LINE_NUM_COEFF", "LINEDENCOEF": "LINE_DEN_COEFF", "SAMPNUMCOEF": "SAMP_NUM_COEFF", "SAMPDENCOEF": "SAMP_DEN_COEFF",
}


def product_tags(text: str) -> dict[str, dict[str, str]]:
    """The namespaces IMD and RPC of a satellite product's XML file; nested names are joined by dots in IMD."""
    out: dict[str, dict[str, str]] = {}
    root = ElementTree.fromstring(text)

    def leaves(node, name: str) -> list[tuple[str, str]]:
        if not len(node):
            return [(name, (node.text or "").strip())]
        return [x for child in node for x in leaves(child, f"{name}.{child.tag}" if name else child.tag)]

    if (node := root.find("IMD")) is not None:
        out["IMD"] = dict(leaves(node, ""))
    if (node := root.find("RPB")) is not None:
        found = {k.rsplit(".", 1)[-1]: v for k, v in leaves(node, "")}
        out["RPC"] = {tag: found[name] for name, tag in _RPC.items() if name in found}
    return out


# Writing --------------------------------------------------------------------


def entry_bytes(tag: int, kind: int, values) -> tuple[int, int, int, bytes]:
    """(tag, type, count, little-endian data)."""
    if kind == 2:
        data = values.encode() + b"\0"
        return tag, kind, len(data), data
    letter = _TYPES[kind][0]
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    return tag, kind, len(values), struct.pack(f"<{len(values)}{letter}", *values)


def directory_size(entries: list[tuple], big: bool = True) -> int:
    """Bytes of a directory and its out-of-line data."""
    return 8 + 20 * len(entries) + 8 + sum(-(-len(e[3]) // 8) * 8 for e in entries if len(e[3]) > 8)


def directory_bytes(entries: list[tuple], at: int, following: int) -> bytes:
    """A Big TIFF directory at an offset, its data behind it."""
    entries = sorted(entries, key=lambda e: e[0])
    extra, where = b"", at + 8 + 20 * len(entries) + 8
    out = struct.pack("<Q", len(entries))
    for tag, kind, count, data in entries:
        out += struct.pack("<HHQ", tag, kind, count)
        if len(data) <= 8:
            out += data.ljust(8, b"\0")
        else:
            out += struct.pack("<Q", where + len(extra))
            extra += data.ljust(-(-len(data) // 8) * 8, b"\0")
    return out + struct.pack("<Q", following) + extra


def ghost_bytes() -> bytes:
    """The description of the layout that follows the header of a cloud-optimized file."""
    parts = {"LAYOUT": "IFDS_BEFORE_DATA", "BLOCK_ORDER": "ROW_MAJOR", "KNOWN_INCOMPATIBLE_EDITION": "NO"}
    body = "".join(f"{k}={v}\n" for k, v in parts.items()) + " "
    return f"{GHOST_KEY}{len(body):06d} bytes\n{body}".encode()


def layout(levels: list[dict], tags: list[tuple]) -> tuple[bytes, list[int]]:
    """The head of a cloud-optimized Big TIFF and, for each level, where its blocks begin.

    A level has entries (without block offsets and counts) and counts, its
    blocks' sizes in file order.  Directories come first, full size first; block
    data follow, smallest level first.  ``tags`` belong to the full size only.
    """
    head_size = 16 + len(ghost_bytes())
    at = -(-head_size // 8) * 8
    full = []
    for i, level in enumerate(levels):
        n = len(level["counts"])
        full.append([*level["entries"], *(tags if i == 0 else []), (324, 16, n, b"\0" * 8 * n), (325, 16, n, b"\0" * 8 * n)])
    starts = []
    for entries in full:
        starts.append(at)
        at += directory_size(entries)
    begins = [0] * len(levels)
    for i in reversed(range(len(levels))):
        begins[i] = at
        at += sum(levels[i]["counts"])
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, starts[0]) + ghost_bytes()
    out = head.ljust(starts[0], b"\0")
    for i, (entries, level) in enumerate(zip(full, levels)):
        where, offsets = begins[i], []
        for c in level["counts"]:
            offsets.append(where if c else 0)
            where += c
        n = len(offsets)
        filled = [e for e in entries if e[0] not in (324, 325)]
        filled += [(324, 16, n, struct.pack(f"<{n}Q", *offsets)), (325, 16, n, struct.pack(f"<{n}Q", *level["counts"]))]
        out += directory_bytes(filled, starts[i], starts[i + 1] if i + 1 < len(levels) else 0)
    return out, begins


def metadata_xml(dataset: dict[str, dict[str, str]], bands: dict[int, dict]) -> str:
    """Tags, band descriptions, scales and offsets in one XML document."""
    root = ElementTree.Element("GDALMetadata")
    for domain, items in dataset.items():
        for k, v in items.items():
            ElementTree.SubElement(root, "Item", {"name": k} | ({"domain": domain} if domain else {})).text = str(v)
    for band, info in bands.items():
        for role in ("description", "scale", "offset"):
            if info.get(role) is not None:
                ElementTree.SubElement(root, "Item", {"name": role.upper(), "sample": str(band - 1), "role": role}).text = str(info[role])
        for k, v in (info.get("tags") or {}).items():
            ElementTree.SubElement(root, "Item", {"name": k, "sample": str(band - 1)}).text = str(v)
    return ElementTree.tostring(root, encoding="unicode") if len(root) else ""
