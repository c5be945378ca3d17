"""Near-duplicate vectors by NN-descent on a neighbour graph.

1. Equal vectors fall together and count as one with a multiplicity.
2. Seeds: random hyperplanes deal the vectors into buckets of a few dozen, in
   so many tables that a pair at the threshold shares a bucket of one with
   probability RECALL, however many vectors there are; a bucket is compared
   exactly, cut into pairs of blocks where it is large.  That gives each vector
   its first neighbours, and links that connect what is linked within a block.
3. NN-descent: at every vector its neighbours and some of those that have it as
   neighbour meet; pairs that improve a list enter it.  Links merge vectors into
   components, whose members take no places in a list: these are for other
   components, and a list saturated by near ones is enlarged in each round.
4. After each round an audit compares vectors of small and of large components
   with all others exactly; rounds, with fresh seeds, go on until the mean of
   their own recall reaches RECALL in both.  Where the audit after the last of ROUNDS finds less, all
   vectors are compared with all, slice by slice.
5. Within each component all pairs are compared, cut into pairs of blocks, and
   only the number of each vector's links leaves a block.

So no pairs of a group of near copies are ever listed; comparing the members of
a component is quadratic by definition of ``n_links``, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_partitions, tidy
from .components import connected_components

#: Tables that are dealt at once; vectors in a bucket, about, and in a block; vectors in a slice that is compared with all.
TABLES, BUCKET, BLOCK, SLICE = 8, 48, 256, 8192
#: Places in a neighbour list for other components; places that a block of a bucket may fill.
NEIGHBOURS, SEEDS = 10, 4
#: A list whose last place has this cosine is saturated; it has twice the places in the next round, for such neighbours.
SATURATED = 0.8
#: Members of a component of more than MANY are compared in blocks of WIDE, so that each is sent to fewer of them.
MANY, WIDE = 4096, 2048
ROUNDS, RECALL, AUDITED = 4, 0.995, 400
NEAR = 1e-5
#: A small component has at most so many vectors; at most so many vectors of small components are audited.
SMALL, AUDIT_MOST = 8, 16384
#: More tables are not dealt before the first audit.
MOST_TABLES = 128


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec binary): unit vectors as doubles; null for vectors that can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                x = np.array(x.as_py() if x.is_valid else [], dtype=np.float64)  # null components become nan
                ok = len(x) and np.isfinite(x).all() and x.any()
                if ok:
                    x = x / np.abs(x).max()
                    x = x / np.sqrt((x * x).sum()) + 0.0
                out.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, type=pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(tidy(run), "vec_id bigint, vec binary")


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def codes(reps: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """(rep, codes): each vector's bucket in every table; vectors of different lengths share none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for x in batch.column("vec").to_pylist():
                x = np.frombuffer(x)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((len(x), TABLES * bits))
                signs = (x @ planes[len(x)] > 0).reshape(TABLES, bits)
                out.append((signs @ (1 << np.arange(bits)) * TABLES + np.arange(TABLES) + (len(x) << 40)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, type=pa.list_(pa.int64()))], ["rep", "codes"])

    return reps.select("rep", "vec").mapInArrow(tidy(run), "rep bigint, codes array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows with equal keys in sorted batches, one at a time."""
    kept, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            here = tuple(ids[:, s].tolist())
            if here != last and kept:
                yield last, pa.Table.from_batches(kept)
                kept = []
            last = here
            kept.append(batch.slice(s, e - s))
    if kept:
        yield last, pa.Table.from_batches(kept)


def tables_for(bits: int, threshold: float) -> int:
    """How many tables make a pair at the threshold share a bucket of one with probability RECALL."""
    same = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return 1 if same == 1 else min(MOST_TABLES, ceil(log(1 - RECALL) / log(1 - same))) if same > 1e-3 else MOST_TABLES


EDGES = "a bigint, b bigint, sim double"


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "sim"])


def in_block_pairs(placed: DataFrame, key: str, rows: DataFrame, wide: int = BLOCK) -> DataFrame:
    """(key, i, j, side, *rows): the members of each key in pairs of blocks i <= j, sorted by pair and side.

    ``placed`` is (rep, key); keys with one member are left out.  Blocks of keys
    with more than MANY members may be ``wide``.
    """
    sizes = placed.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key, F.ceil(F.col("c") / F.when(F.col("c") > MANY, wide).otherwise(BLOCK)).alias("n"))
    dealt = placed.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), "n"))
    up = F.transform(F.sequence(F.col("own"), F.col("n") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    down = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("own"), F.lit(1))), lambda i: F.struct((i - 1).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    dealt = dealt.select("rep", key, F.explode(F.when(F.col("own") > 0, F.concat(up, down)).otherwise(up)).alias("p")).select("rep", F.col(key).alias("key"), "p.i", "p.j", "p.side")
    return dealt.join(rows, "rep").repartition(n_partitions(placed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of a symmetric matrix's links that connect all that it connects, by spreading the least place."""
    label, a, b = np.arange(len(linked)), [], []
    while True:
        seen = np.where(linked, label, len(label))
        at = seen.argmin(axis=1)
        better = np.flatnonzero(seen[np.arange(len(label)), at] < label)
        if not len(better):
            return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        a += better.tolist()
        b += at[better].tolist()
        label = label.copy()
        label[better] = seen[better, at[better]]


def seeds(reps: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b, sim) from the buckets: links that connect what is linked in a block, and each vector's best few."""
    rows = in_block_pairs(coded.select("rep", F.explode("codes").alias("bucket")), "bucket", reps.select("rep", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for (_, i, j), t in _runs(batches, ["key", "i", "j"]):
            t = t.combine_chunks()
            rep, x = t.column("rep").to_numpy(), _matrix(t.column("vec"))
            cut = int((t.column("side").to_numpy() == 0).sum())
            if len(rep) < 2 or cut == 0 or (i != j and cut == len(rep)):
                continue
            sim = x @ x.T
            np.fill_diagonal(sim, -2.0)
            a, b = spanning(sim >= threshold)
            parts.append((rep[a], rep[b], sim[a, b]))
            sim = sim[:cut] if i == j else sim[:cut, cut:]
            k = min(SEEDS, sim.shape[1])
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            a = np.repeat(np.arange(cut), k)
            parts.append((rep[a], rep[near.ravel() + (0 if i == j else cut)], sim[a, near.ravel()]))
            if len(parts) > 500:
                yield _edges(parts)
                parts = []
        yield _edges(parts)

    return ordered(rows.mapInArrow(tidy(run), EDGES).where("sim > -1.5"))


def ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def lists(edges: DataFrame, located: DataFrame, places: int) -> DataFrame:
    """(c, m, sim, place): each vector's best neighbours in other components, from edges (a, b, sim).

    Up to NEIGHBOURS of them, and in a saturated list up to ``places``.
    """
    comp = lambda x: located.select(F.col("rep").alias(x), F.col("comp").alias(f"comp_{x}"))
    apart = edges.join(comp("a"), "a").join(comp("b"), "b").where("comp_a != comp_b")
    both = apart.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("m")), F.struct(F.col("b").alias("c"), F.col("a").alias("m")))).alias("e"), "sim").select("e.*", "sim")
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("sim"), "m"))).where(F.col("place") <= places)
    return ranked.where((F.col("place") <= NEIGHBOURS) | (F.col("sim") >= SATURATED))


def local_joins(graph: DataFrame, located: DataFrame, threshold: float, step: int, places: int) -> DataFrame:
    """Edges (a, b, sim) between the neighbours of each vector that are in different components and improve a list or are links."""
    last = F.max(F.when(F.col("place") == NEIGHBOURS, F.col("sim")))
    open_ = F.when(F.count("*") < places, F.least(last, F.lit(SATURATED)))  # what may enter a list that has NEIGHBOURS
    reverse = graph.select(F.col("m").alias("c"), F.col("c").alias("m")).withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("m", F.lit(step))))).where(F.col("place") <= NEIGHBOURS)
    members = graph.select("c", "m").union(reverse.select("c", "m")).distinct()
    worst = graph.groupBy(F.col("c").alias("m")).agg(F.when(F.count("*") >= NEIGHBOURS, F.coalesce(open_, F.min("sim"))).otherwise(F.lit(-1.0)).alias("worst"))
    light = located.select(F.col("rep").alias("m"), "comp", "vec").join(worst, "m", "left").select("m", "comp", "vec", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    rows = members.join(light, "m").repartition(n_partitions(graph.sparkSession), "c").sortWithinPartitions("c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, t in _runs(batches, ["c"]):
            if len(t) < 2:
                continue
            t = t.combine_chunks()
            rep, comp, x, worst = t.column("m").to_numpy(), t.column("comp").to_numpy(), _matrix(t.column("vec")), t.column("worst").to_numpy()
            sim = x @ x.T
            good = (sim > np.minimum(worst[:, None], worst[None, :])) | (sim >= threshold)
            a, b = np.nonzero(good & (comp[:, None] != comp) & np.tri(len(rep), k=-1, dtype=bool))
            parts.append((rep[a], rep[b], sim[a, b]))
            if len(parts) > 500:
                yield _edges(parts)
                parts = []
        yield _edges(parts)

    return ordered(rows.mapInArrow(tidy(run), EDGES))


def all_links(located: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, sim) that connect all linked vectors of different components, from slices compared with all."""
    context, n, out = located.sparkSession.sparkContext, ceil(located.count() / SLICE), None

    def against(packed) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts, size = [], np.array([len(v) for v in batch.column("vec").to_pylist()])
                for length, (ids, comps, q) in packed.value.items():
                    some = batch.filter(pa.array(size == length))
                    if not some.num_rows:
                        continue
                    rep, comp, x = some.column("rep").to_numpy(), some.column("comp").to_numpy(), _matrix(some.column("vec"))
                    for at in range(0, len(ids), 512):
                        here = slice(at, at + 512)
                        sim = q[here] @ x.T
                        linked = (sim >= threshold) & (comps[here, None] != comp)
                        i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                        for k in range(0, len(j), 1024):
                            few = j[k : k + 1024]
                            square = np.zeros((len(i) + len(few),) * 2, dtype=bool)
                            square[: len(i), len(i) :] = linked[np.ix_(i, few)]
                            a, b = spanning(square | square.T)
                            a, b = np.minimum(a, b), np.maximum(a, b) - len(i)
                            parts.append((ids[here][i[a]], rep[few[b]], sim[i[a], few[b]]))
                yield _edges(parts)

        return checkpoint(ordered(located.select("rep", "vec", "comp").mapInArrow(tidy(run), EDGES)))

    for k in range(n):
        packed = context.broadcast(_packed(located.where(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(n)) == k)))
        found = against(packed)
        packed.destroy()
        out = found if out is None else out.union(found)
    return out


def _packed(located: DataFrame) -> dict:
    """By vector length: ids, components and a matrix of the vectors."""
    by: dict[int, list] = {}
    for r in located.select("rep", "vec", "comp").collect():
        by.setdefault(len(r["vec"]), []).append((r["rep"], r["comp"], np.frombuffer(r["vec"])))
    return {n: (np.array([q[0] for q in some]), np.array([q[1] for q in some]), np.stack([q[2] for q in some])) for n, some in by.items()}


def sample(located: DataFrame) -> DataFrame:
    """(rep, vec, comp, small): vectors to audit, from components of at most SMALL and from larger ones.

    Of large components about AUDITED vectors are drawn.  Of small ones, single
    vectors among them, so many that about AUDITED have a link, as far as found
    components tell, and AUDIT_MOST at most.
    """
    sized = located.join(located.groupBy("comp").agg(F.count("*").alias("size")), "comp").withColumn("small", F.col("size") <= SMALL)
    n = sized.agg(F.count_if("small").alias("small"), F.count_if(F.col("small") & (F.col("size") > 1)).alias("linked"), F.count_if(~F.col("small")).alias("large")).first()
    draw = min(AUDIT_MOST, ceil(AUDITED * n["small"] / max(1, n["linked"])))
    share = F.when(F.col("small"), F.lit(draw / max(1, n["small"]))).otherwise(F.lit(AUDITED / max(1, n["large"])))
    turn = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return sized.where(turn < share).select("rep", "vec", "comp", "small")


def audit(located: DataFrame, threshold: float) -> float:
    """The mean share of its own true links that an audited vector has within its component.

    Each vector that has a link counts once, however many it has; the mean is
    taken apart for small and large components, and the lesser one counts.
    """
    chosen = checkpoint(sample(located))
    small = {r["rep"]: r["small"] for r in chosen.select("rep", "small").collect()}
    packed = located.sparkSession.sparkContext.broadcast(_packed(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros((2, len(ids)), dtype=np.int64) for n, (ids, _, _) in packed.value.items()}
        for batch in batches:
            size = np.array([len(v) for v in batch.column("vec").to_pylist()])
            for n, (ids, comps, q) in packed.value.items():
                some = batch.filter(pa.array(size == n))
                if not some.num_rows:
                    continue
                rep, comp, x = some.column("rep").to_numpy(), some.column("comp").to_numpy(), _matrix(some.column("vec"))
                for at in range(0, len(ids), 512):
                    a, b = np.nonzero(q[at : at + 512] @ x.T >= threshold)
                    a, b = a[ids[a + at] != rep[b]] + at, b[ids[a + at] != rep[b]]
                    sums[n][0] += np.bincount(a, minlength=len(ids))
                    sums[n][1] += np.bincount(a[comps[a] == comp[b]], minlength=len(ids))
        for n, (ids, _, _) in packed.value.items():
            has = sums[n][0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(sums[n][0][has]), pa.array(sums[n][1][has])], ["rep", "true", "found"])

    rows = located.select("rep", "vec", "comp").mapInArrow(tidy(run), "rep bigint, true bigint, found bigint").groupBy("rep").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).collect()
    packed.destroy()
    shares: dict[bool, list[float]] = {}
    for r in rows:
        shares.setdefault(small[r["rep"]], []).append(r["found"] / r["true"])
    return min((sum(x) / len(x) for x in shares.values()), default=1.0)


def link_counts(located: DataFrame, threshold: float) -> DataFrame:
    """(rep, others): with how many vectors, copies counted, each is linked within its component."""
    rows = in_block_pairs(located.select("rep", "comp"), "comp", located.select("rep", "n", "vec"), WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _runs(batches, ["key", "i", "j"]):
            t = t.combine_chunks()
            rep, n, x = t.column("rep").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("vec"))
            cut = int((t.column("side").to_numpy() == 0).sum())
            if i == j:
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                counts = linked @ n
            else:
                linked = x[:cut] @ x[cut:].T >= threshold
                counts = np.concatenate([linked @ n[cut:], linked.T @ n[:cut]])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(counts.astype(np.int64))], ["rep", "others"])

    return rows.mapInArrow(tidy(run), "rep bigint, others bigint").groupBy("rep").agg(F.sum("others").alias("others"))


def with_components(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` with the column comp, the least rep reachable by links."""
    merged = connected_components(links).select(F.col("node").alias("rep"), "component")
    return reps.select("rep", "n", "vec").join(merged, "rep", "left").select("rep", "n", "vec", F.coalesce("component", "rep").alias("comp"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are linked if their cosine, in double precision, reaches the
    threshold.  Null and zero vectors, those with null or non-finite components
    and rows with a null id link with nothing (0 links, a component of their
    own; a null id has a null component and is kept).  Repeated rows are equal
    vectors and count as links of each other.  Vectors of different lengths are
    never linked.  Ids may be any of bigint.  An empty table gives an empty result.
    """
    units = checkpoint(unit_vectors(vectors, id_col, vec_col))
    usable = units.where("vec is not null and vec_id is not null")
    reps = checkpoint(usable.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    total = reps.count()
    bits = max(1, ceil(log2(max(2, total / BUCKET))))
    batches = ceil(tables_for(bits, threshold) / TABLES)
    edges = None
    for batch in range(batches):
        more = seeds(reps, codes(reps, bits, batch), threshold)
        edges = checkpoint(more if edges is None else ordered(edges.union(more)))
    links = edges.where(F.col("sim") >= threshold)
    located = checkpoint(with_components(reps, links))
    for step in range(ROUNDS):
        if step:
            if audit(located, threshold) >= RECALL:
                break
            fresh = checkpoint(seeds(reps, codes(reps, bits, batches + step), threshold))
            edges, links = ordered(edges.union(fresh)), links.union(fresh.where(F.col("sim") >= threshold))
            located = checkpoint(with_components(reps, links))
        places = NEIGHBOURS << step
        graph = checkpoint(lists(edges, located, places))
        met = checkpoint(local_joins(graph, located, threshold, step, places))
        links = checkpoint(links.union(met.where(F.col("sim") >= threshold)))
        edges = checkpoint(ordered(met.union(graph.select(F.col("c").alias("a"), F.col("m").alias("b"), "sim"))))
        located = checkpoint(with_components(reps, links))
    else:
        if audit(located, threshold) < RECALL:
            located = checkpoint(with_components(reps, links.union(all_links(located, threshold))))
    classes = located.join(link_counts(located, threshold), "rep", "left").select("vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "comp")
    linkable = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    out = units.where(linkable).join(classes, "vec").select("vec_id", "links", "comp").union(units.where(~linkable).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(True)).alias("kept"))
