import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.errors import CodecUnavailable
from gridloom.functions import codecs
from gridloom.sources import tiff


@pytest.mark.parametrize("name", [None, "DEFLATE", "LZMA", "ZSTD", "PACKBITS", "LZW"])
@settings(max_examples=40, deadline=None)
@given(data=st.one_of(st.binary(max_size=3000), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 400)), max_size=40).map(lambda x: b"".join(bytes([b]) * n for b, n in x))))
def test_codecs_round_trip(name, data):
    assert codecs.decompress(codecs.compress(data, name), name, len(data)) == data


def test_lzw_over_many_codes():
    data = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert codecs.unlzw(codecs.lzw(data)) == data


@pytest.mark.parametrize("name", ["JPEG", "WEBP", "LERC"])
def test_missing_codec_is_named(name):
    with pytest.raises(CodecUnavailable, match=name):
        codecs.compress(b"x", name)


def test_predictor():
    x = np.random.default_rng(1).integers(0, 60000, (5, 7, 3)).astype(np.uint16)
    assert (codecs.undo_predictor(codecs.apply_predictor(x, 2), 2) == x).all()


def hand_made(order: str = "<", big: bool = False, width: int = 5, rows_per_strip: int = 2) -> tuple[bytes, np.ndarray]:
    """A striped file with one 16-bit band."""
    x = (np.arange(width * 5) * 7).reshape(5, width).astype(f"{order}u2")
    strips = [x[i : i + rows_per_strip].tobytes() for i in range(0, 5, rows_per_strip)]
    head = 16 if big else 8
    offsets, at = [], head
    for s in strips:
        offsets.append(at)
        at += len(s)
    body, word = b"".join(strips), "Q" if big else "I"
    entries = [(256, 3, 1, width), (257, 3, 1, 5), (258, 3, 1, 16), (259, 3, 1, 1), (262, 3, 1, 1), (277, 3, 1, 1), (278, 3, 1, rows_per_strip)]
    lists = [(273, offsets), (279, [len(s) for s in strips])]
    size = (8 if big else 2) + (len(entries) + 2) * (20 if big else 12) + (8 if big else 4)
    after, extra, out = at + size, b"", []
    for tag, kind, n, v in entries:
        out.append((tag, struct.pack(f"{order}HH{word}", tag, kind, n) + struct.pack(f"{order}H", v).ljust(8 if big else 4, b"\0")))
    for tag, values in lists:
        data = struct.pack(f"{order}{len(values)}I", *values)
        out.append((tag, struct.pack(f"{order}HH{word}{word}", tag, 4, len(values), after + len(extra))))
        extra += data
    ifd = struct.pack(f"{order}{'Q' if big else 'H'}", len(out)) + b"".join(e for _, e in sorted(out)) + struct.pack(f"{order}{word}", 0)
    mark = b"II" if order == "<" else b"MM"
    first = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    return first + body + ifd + extra, x


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_both_byte_orders_and_sizes(order, big):
    data, x = hand_made(order, big)
    t = tiff.parse(lambda at, n: data[at : at + n])
    d = t.directories[0]
    assert (d.width, d.height, d.block, t.big) == (5, 5, (2, 5), big)
    rows = [tiff.decode_block(d, r, data[o : o + n])[:, :, 0] for _, r, _, o, n in d.blocks()]
    assert (np.concatenate(rows) == x).all()


def test_not_a_tiff():
    with pytest.raises(tiff.NotTiff):
        tiff.parse(lambda at, n: b"\x89PNG0000"[at : at + n])


def test_metadata_round_trip():
    xml = tiff.metadata_xml({"": {"A": "1"}, "RPC": {"B": "x<y"}}, {1: {"description": "first", "scale": 2.0, "tags": {"k": "v"}}})
    d = tiff.Directory(0, {42112: xml}, "<")
    assert d.metadata() == {"dataset": {"": {"A": "1"}, "RPC": {"B": "x<y"}}, "bands": {1: {"description": "first", "scale": 2.0, "tags": {"k": "v"}}}}
