"""Words and word shingles of Arrow text columns as 64-bit hashes, in NumPy.

The bytes of a whole slice of documents are handled at once, and slices are
cut so that working memory stays a small multiple of ``SLICE_BYTES`` (a single
longer document is a slice of its own).  Nothing is truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that scatters 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        part = x >> _U(30)
        x ^= part
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, _U(27), out=part)
        x *= _U(0x94D049BB133111EB)
        x ^= np.right_shift(x, _U(31), out=part)
        return x


_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_VALUES = mix(np.arange(256, dtype=_U) * _U(7919))[_fold]
_P = _U(0x100000001B3 * 2 + 1)

#: Bytes that belong to a word when only ASCII white space separates words.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, byte offsets, bytes) of runs of documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:  # else the texts are not copied
        texts = pc.fill_null(texts, "")
    n, kind = len(texts), np.int32 if pa.types.is_string(texts.type) else np.int64
    off = np.frombuffer(texts.buffers()[1] or bytes(8), dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j - i, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def word_starts(off: np.ndarray, data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before each document, first byte of each word, byte after each word) of one slice."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = member[data]
    turn = inside[1:] != inside[:-1]
    edges = off[1:-1]
    turn[edges[inside[edges] & inside[edges + 1]]] = True  # a word on either side of a document's end
    at = np.flatnonzero(turn)
    begins = inside[at + 1]
    ends = inside[at]
    start, stop = at[begins], at[ends]
    return np.searchsorted(start, off), start, stop


_tables: dict[str, np.ndarray] = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the odd factor _P, and of its inverse; those for a slice are kept, a longer text has its own."""
    if len(_tables["up"]) >= n:
        return _tables["up"], _tables["down"]
    out = []
    for base in (int(_P), pow(int(_P), -1, 1 << 64)):
        x = np.full(max(n, SLICE_BYTES + 4096), base, dtype=_U)
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(x))
    if len(out[0]) == SLICE_BYTES + 4096:
        _tables["up"], _tables["down"] = out
    return out[0], out[1]


def word_hashes(off: np.ndarray, data: np.ndarray, member: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(words before each document, word hashes) of one slice; A-Z count as a-z.

    A word's hash comes from its letters' polynomial, which is the difference
    of two running sums, shifted to the word's start.
    """
    bounds, start, stop = word_starts(off, data, member)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
        words = (sums[stop] - sums[start]) * down[start] * _P
        return bounds, mix(words + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct k-word shingle hashes of each document).

    A document of fewer than k words has its whole sequence as one shingle; a
    document without words has the empty set.
    """
    for row, n, off, data in slices(texts):
        bounds, words = word_hashes(off, data)
        runs = chained(words, k)
        out = []
        for d in range(n):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if b - a >= k:
                out.append(distinct(runs[a : b - k + 1]))
            elif b > a:
                out.append(chained(words[a:b], b - a)[:1])
            else:
                out.append(words[:0])
        yield row, out


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a non-empty array."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def chained(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words; runs near the end are left out."""
    m = max(0, len(words) - k + 1)
    h = np.full(m, k, dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * _U(0xC2B2AE3D27D4EB4F) + words[i : i + m])
    return h


def fingerprint(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set of hashes."""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prefix_hashes(off: np.ndarray, data: np.ndarray, lengths: tuple[int, ...], member: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """``word_hashes`` and, for each length, the hashes of the words' first bytes (a shorter word is its own prefix)."""
    bounds, start, stop = word_starts(off, data, member)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
        before, shift = sums[start], down[start]

        def ending(at: np.ndarray) -> np.ndarray:
            return mix((sums[at] - before) * shift + (at - start).astype(_U) * _U(0xD6E8FEB86659FD93))

        words = mix((sums[stop] - before) * shift * _P + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))
        return bounds, words, {n: ending(np.minimum(stop, start + n)) for n in lengths}
