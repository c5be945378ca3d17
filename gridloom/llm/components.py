"""Connected components of an edge list: forests of parts, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tidy

#: Edges (16 bytes each) that one task contracts at a time.
PART = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each is connected with) of some edges, all nodes but those least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != (further := label[label])).any():
            label = further
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v): edges (u, v) as stars, run by run of about PART edges in each of so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("u", "v")))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                if n and n + batch.num_rows > PART:
                    yield out()
                    kept, n = [], 0
                kept.append(batch)
                n += batch.num_rows
        if kept:
            yield out()

    return edges.coalesce(parts).mapInArrow(tidy(run), "u bigint, v bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its least node.

    Up to PART edges are contracted by one task.  More are contracted in parts,
    and what is left is merged by large-star and small-star steps in turn until
    it forms stars.  Each of these is one map-side combined aggregate and one
    equi-join that adaptive execution may split, so a hub with a third of all
    edges is no single task.  Ids may be any of bigint.  Null ends and loops are
    ignored; without other edges there is no row.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpoint(e)
    n = e.count()
    e = checkpoint(contracted(e, max(1, ceil(n / PART))))
    if n > PART:
        for _ in range(rounds):
            if stars(e):
                break
            e = checkpoint(merged(e))
        else:
            raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    return e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def merged(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v), u > v."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small.where("u != v").distinct()
