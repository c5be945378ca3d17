"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words' shapes (runs of small letters, capitals, digits
and each other sign), pairs of shapes that follow each other, words that repeat
the one before, and the words themselves, hashed to ``TERMS`` columns.  Term
weights go through a truncated singular value decomposition that is fitted on a
bounded sample of labelled rows; so are the voters, whose vectors are broadcast
(at most LABELLED x DIMENSIONS numbers).  Every document is compared with every
voter by exact cosine products, in blocks, and the nearest voters' labels are
averaged, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .textnum import _P, _VALUES, SPACED, mix, slices, word_hashes

TERMS = 4096
DIMENSIONS = 48
#: At most so many labelled rows fit the decomposition and vote.
LABELLED = 4096
NEIGHBOURS = 25
#: Documents in one block of products.
BLOCK = 512

_shape = np.arange(256, dtype=np.uint8)
_shape[97:123] = _shape[128:] = 1
_shape[65:91] = 2
_shape[48:58] = 3


def term_weights(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, dense term weights) of slices: square roots of relative frequencies."""
    for row, n, off, data in slices(texts):
        bounds, words = word_hashes(off, data, SPACED)
        lengths = np.diff(bounds)
        out = np.zeros((n, TERMS), dtype=np.float32)
        if len(words):
            doc = np.repeat(np.arange(n), lengths)
            shapes = _shapes(off, data)
            first = np.zeros(len(words), dtype=bool)
            first[bounds[:-1][lengths > 0]] = True
            with np.errstate(over="ignore"):
                pair = mix(np.append(np.uint64(0), shapes[:-1]) * np.uint64(3) + shapes)
            again = np.append(False, words[1:] == words[:-1]) & ~first
            for h, some, weight in ((shapes, slice(None), 1.0), (pair, ~first, 1.0), (words & np.uint64(0) | np.uint64(99), again, 1.0), (words, slice(None), 0.05)):
                slot = (h[some] % np.uint64(TERMS)).astype(np.int64)
                out += (weight * np.bincount(doc[some] * TERMS + slot, minlength=n * TERMS)).reshape(n, TERMS)
            out = np.sqrt(out / np.maximum(lengths, 1)[:, None], dtype=np.float32)
        yield row, out


def _shapes(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The hash of each word's shape."""
    inside = SPACED[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[off] = False
    at = np.flatnonzero(inside)
    start = ~before[at]
    sign = _shape[data[at]]
    turn = start.copy()
    turn[1:] |= sign[1:] != sign[:-1]
    sign, start = sign[turn], start[turn]
    first = np.flatnonzero(start)
    place = np.arange(len(sign)) - np.repeat(first, np.diff(np.append(first, len(sign))))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _P, dtype=np.uint64))
        return mix(np.add.reduceat(_VALUES[sign] * powers[place], first))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(weights: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The map from term weights to latent-semantic space: idf times the leading right singular vectors."""
    idf = np.log((1 + len(weights)) / (1 + (weights > 0).sum(axis=0))).astype(np.float32) + 1
    x = unit(weights * idf)
    k = max(1, min(dimensions, *x.shape))
    q = np.linalg.qr(x.T @ (x @ np.random.default_rng(0).standard_normal((x.shape[1], k + 8)).astype(np.float32)))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (idf[:, None] * (q @ vt.T[:, :k])).astype(np.float32)


def vote(vectors: np.ndarray, voters: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The similarity-weighted mean label of each vector's nearest voters, all those included that are as near as the last; of all voters for a zero vector."""
    base = float(labels.mean()) if len(labels) else 0.5
    out = np.full(len(vectors), base)
    k = min(neighbours, len(voters))
    for i in range(0, len(vectors), BLOCK) if k else ():
        cosine = vectors[i : i + BLOCK] @ voters.T
        last = np.partition(cosine, len(voters) - k, axis=1)[:, len(voters) - k]
        row, near = np.nonzero(cosine >= last[:, None] - 1e-6)
        w = np.maximum(cosine[row, near], 0).astype(np.float64) ** 4
        total, good = (np.bincount(row, weights=x, minlength=len(cosine)) for x in (w, w * labels[near]))
        out[i : i + BLOCK] = np.where(total > 0, good / np.maximum(total, 1e-12), base)
    return np.clip(out, 0, 1)


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(text, quality) of at most ``bound`` labelled documents outside the held-out fold, in hash order."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = labels.where(F.col("quality").isNotNull() & (fold != 0)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))


def score_quality(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; ``train`` has text and quality, at most LABELLED rows.

    Null, empty and blank texts have a zero vector and get the mean label, as
    do all rows where nothing is labelled (then 0.5).  Ids are carried through,
    null or repeated; an empty table gives an empty result.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in term_weights(batch.column("text")):
                data = [v[np.flatnonzero(v)] for v in x]
                at = [np.flatnonzero(v).astype(np.int32) for v in x]
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(row, len(x)), pa.array(at, type=pa.list_(pa.int32())), pa.array(data, type=pa.list_(pa.float32()))], ["quality", "at", "weight"])

    train = train.orderBy(F.xxhash64("text"), "quality").limit(LABELLED)
    rows = train.mapInArrow(tidy(weigh), "quality int, at array<int>, weight array<float>").toArrow()
    rows = rows.sort_by("quality")
    x = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, (at, w) in enumerate(zip(rows.column("at"), rows.column("weight"))):
        x[i, at.values.to_numpy()] = w.values.to_numpy()
    space = fit(x) if len(x) else np.zeros((TERMS, 1), dtype=np.float32)
    model = docs.sparkSession.sparkContext.broadcast((space, unit(x @ space), rows.column("quality").to_numpy().astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, voters, labels = model.value
        for batch in batches:
            for row, x in term_weights(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(x)), pa.array(vote(unit(x @ space), voters, labels))], ["doc_id", "score"])

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(tidy(score), f"doc_id {dict(ids.dtypes)['doc_id']}, score double")
