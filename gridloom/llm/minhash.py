"""Near-duplicate documents by SetSketch registers, banding, likelihood and verification.

A register holds the least of exponentially distributed points that a shingle
set throws at it, on a logarithmic scale and truncated to 16 bits.  The points
of one shingle are a Poisson process dealt over all registers at random, so a
large set needs a few points per register only, registers are independent, and
sketches of parts merge by taking the maximum.  Equal registers are about as
likely as the Jaccard similarity.

1. Documents with the same shingle set fall together by fingerprint.
2. Bands of registers give each distinct set its buckets.
3. Stars: each set is paired with a few hubs of its buckets; pairs whose
   estimated similarity is plausible are verified on the full sets, and verified
   links merge components.  Only buckets with several components go on.
4. The rest: in the buckets left, sets in different components are compared by
   the joint likelihood of their registers.  First the likeliest pairs of a set
   and another component are verified, as one link merges them; then, in what is
   still apart, all plausible pairs are, block by block on the full sets, and of
   the links between a set and a component one is kept.  Buckets are cut into
   blocks, so no task holds more than two blocks of one.

Groups are never expanded into pairs beyond that, and no link between different
components is left unexamined.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, joinable, n_partitions, tidy
from .components import connected_components
from .textnum import fingerprint, mix, shingle_sets

#: 40 bands of 5 registers: a pair of similarity 0.8 shares no band with probability 1.2e-7.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: Pairs are verified unless their estimate lies this far below the threshold (more than 4 standard errors).
SLACK = 0.12
#: Hubs for each set.
STARS = 3
#: Weight of a block: each set counts 1 and its shingles 1 / SHINGLES.
BLOCK, SHINGLES = 256, 1000
#: Sets compared with one hub in one run of rows.
CHUNK = 64
#: Pairs of a set and another component that each block verifies first.
FIRST = 3
#: Pairs of sketches that are compared in one go.
PAIRS = 20_000

_U = np.uint64


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (uint16) of shingle sets; the empty set has zeros.

    Each element's points come one after the other, ever later; of one hash the
    high 40 bits give the distance to the next point and the low 24 its
    register.  Elements stop at a time by which nearly all registers of their
    set are filled; sets with gaps start again with a later one.
    """
    out = np.zeros((len(sets), m), dtype=np.uint16)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    reach = 2.0
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        least = np.full(len(todo) * m, np.inf, dtype=np.float32)
        element = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.arange(len(todo)) * m, sizes)
        end = np.repeat((-(log(m) + reach) / (sizes * RATE)).astype(np.float32), sizes)
        at, step = np.zeros(len(element), dtype=np.float32), 0  # times are below 0: logarithms are added up as they are
        while len(element):
            turns = 1 if len(element) > 8192 else 32  # few elements take many points at once
            with np.errstate(over="ignore"):
                h = mix(element[:, None] + np.arange(step, step + turns, dtype=_U) * _U(0xA24BAED4963EE407))
            part = ((h >> _U(24)) + _U(1)).astype(np.float32)
            part *= np.float32(2.0**-40)
            np.log(part, out=part)
            part *= np.float32(1 / (m * RATE))
            part[:, 0] += at
            np.cumsum(part, axis=1, out=part)
            which, turn = np.nonzero(part >= end[:, None])
            h, found = h[which, turn], part[which, turn]
            np.minimum.at(least, row[which] + ((h & _U(0xFFFFFF)).astype(np.int64) * m >> 24), -found)
            live = which[turn == turns - 1]
            element, row, end, at = element[live], row[live], end[live], part[live, turns - 1]
            step += turns
        least = least.reshape(len(todo), m)
        full = np.isfinite(least).all(axis=1)
        values = np.floor(1.0 - np.log(np.maximum(least[full], np.float32(1e-30)).astype(np.float64)) / log(BASE))
        out[todo[full]] = np.clip(values, 0, 65535).astype(np.uint16)
        todo, reach = todo[~full], reach + 4.0
    return out


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of greater and lesser registers and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    c, lb = (BASE - 1) / BASE, log(BASE)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * c) / lb
    dp = lambda x: c / ((1 - np.maximum(x, 0) * c) * lb)
    same = m - more - less
    for _ in range(24):
        j = (low + high) / 2
        a, b = u - v * j, v - u * j
        pa_, pb = np.maximum(p(a), 1e-12), np.maximum(p(b), 1e-12)
        da, db = -v * dp(a), -u * dp(b)
        slope = more * da / pa_ + less * db / pb - same * (da + db) / np.maximum(1 - pa_ - pb, 1e-12)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, share: float, alike: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sketches (rows of a and b) may reach the threshold; ``alike`` are their equal registers, if known."""
    ok = np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b)
    alike = (a == b).sum(axis=1) if alike is None else alike
    at = np.flatnonzero(ok & (alike >= (share - 2 * SLACK) * a.shape[1]))
    found = np.zeros(len(a), dtype=bool)
    if len(at):
        more = (a[at] > b[at]).sum(axis=1)
        found[at] = estimate(more, a.shape[1] - alike[at] - more, n_a[at], n_b[at], a.shape[1]) >= share - SLACK
    return found


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, fp, regs) of documents given as (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), k):
                regs = sketch(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], type=pa.binary()),
                        pa.array([r.tobytes() for r in regs], type=pa.binary()),
                    ],
                    ["doc_id", "n", "fp", "regs"],
                )

    return docs.mapInArrow(tidy(run), "doc_id bigint, n bigint, fp binary, regs binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, band, rep) of every band of (rep, regs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _registers(batch.column("regs")).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), regs.shape[:2]).copy()
                for r in range(ROWS):
                    key = mix(key * _U(0x9DDFEA08EB382D69) + regs[:, :, r])
            rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(rep)], ["key", "band", "rep"])

    return reps.select("rep", "regs").mapInArrow(tidy(run), "key bigint, band int, rep bigint")


def likely(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sketches make the threshold plausible."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("n_a", "n_b") >= F.lit(share) * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_registers(batch.column(f"regs_{s}")) for s in "ab")
                ok = plausible(x, y, *(batch.column(f"n_{s}").to_numpy() for s in "ab"), share)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(tidy(run), "a bigint, b bigint")


def chosen_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text (doc_id, text) of each id of ``wanted``."""
    return checkpoint(texts.join(joinable(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |A & B| >= num * |A | B| on their full shingle sets.

    Each text a is sent once for every run of about CHUNK partners, and a task
    streams through its runs with one full set at a time.
    """
    spark = pairs.sparkSession
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    runs = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / CHUNK)).alias("run"))
    runs = checkpoint(runs)
    full = chosen_texts(texts, runs.select(F.col("a").alias("doc_id")).union(runs.select(F.col("b").alias("doc_id"))).distinct())
    heads = runs.select("a", "run").distinct().join(full, F.col("a") == F.col("doc_id")).select("a", "run", F.lit(None).cast("bigint").alias("b"), "text")
    members = runs.join(full, F.col("b") == F.col("doc_id")).select("a", "run", "b", "text")
    rows = heads.union(members).repartition(n_partitions(spark), "a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=_U)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for row, sets in shingle_sets(batch.column("text"), k):
                for i, s in enumerate(sets, row):
                    if b[i] is None:
                        head = s
                    else:
                        common = len(np.intersect1d(head, s, assume_unique=True))
                        if den * common >= num * (len(head) + len(s) - common):
                            keep.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], type=pa.int64()), pa.array([y for _, y in keep], type=pa.int64())], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a bigint, b bigint")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each set with the STARS hubs that it shares most bands with.

    Every bucket names its least sets by STARS hash orders as hubs.  A set meets
    at most BANDS * STARS of them; sharing many bands is being similar, so the
    few that are verified are near ones.
    """
    order = lambda i: F.xxhash64("rep", F.lit(i))
    # Written, so that the join's other side can be split where a bucket is large.
    hubs = checkpoint(shared.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("rep", order(i)) for i in range(STARS)))).alias("hubs")))
    met = shared.join(hubs, "key").select(F.col("rep").alias("b"), F.explode("hubs").alias("a")).where("a != b")
    bands = met.groupBy("b", "a").agg(F.count("*").alias("n"))
    best = bands.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), asc=False), 1, STARS).alias("best"))
    return best.select(F.explode("best.a").alias("a"), "b")


def left_over(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, band, rep, comp) of the buckets that hold more than one component; ``comps`` (rep, comp) may leave out sets by themselves."""
    labelled = shared.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return labelled.join(joinable(mixed), "key", "left_semi")


SIDES = "key long, i long, j long, side int, band int, rep long, comp long, size long, regs binary"


def dealt(rest: DataFrame, reps: DataFrame) -> DataFrame:
    """SIDES: the sets of the buckets of ``rest``, dealt to pairs of blocks, each pair in one run of rows.

    Sets outside their bucket's largest component (side 0) meet all sets of the
    bucket (side 1); both sides are cut into blocks of about BLOCK sets, fewer
    where sets are large, so a pair of blocks has a bounded number of shingles
    beside its largest set.
    """
    all_ = rest.join(reps.select("rep", F.col("n").alias("size"), "regs"), "rep")
    counts = all_.groupBy("key", "comp").agg(F.sum(SHINGLES + F.col("size")).alias("c"))
    main = counts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("n"), F.max("c").alias("top"))
    main = main.select("key", "main", F.ceil((F.col("n") - F.col("top")) / (BLOCK * SHINGLES)).alias("rows"), F.ceil(F.col("n") / (BLOCK * SHINGLES)).alias("cols"))
    all_ = all_.join(joinable(main), "key")  # written first, so that rows of a large bucket can be split in the join
    deal = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    cols = ["band", "rep", "comp", "size", "regs"]
    left = all_.where("comp != main").select("key", deal("rows").alias("i"), others("cols").alias("j"), F.lit(0).alias("side"), *cols)
    right = all_.select("key", deal("cols").alias("j"), others("rows").alias("i"), F.lit(1).alias("side"), *cols).select("key", "i", "j", "side", *cols)
    return in_runs(left.union(right))


def in_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition(n_partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")


def _sides(t: pa.Table) -> list[np.ndarray]:
    """What ``block_pairs`` takes first."""
    group = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
    return [group, *(t.column(c).to_numpy() for c in ("side", "band", "comp", "size")), _registers(t.column("regs"))]


def likeliest_pairs(rows: DataFrame, share: float) -> DataFrame:
    """(a, b) of the FIRST likeliest partners of each set in every other component of a pair of blocks.

    A pair is given by the first band that it shares only; that bucket too holds
    both components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"]):
            rep = t.column("rep").to_numpy()
            found = [(rep[x], rep[y]) for x, y in block_pairs(*_sides(t), share, FIRST)]
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def undecided(rows: DataFrame, share: float) -> DataFrame:
    """The rows of ``dealt`` that are in a plausible pair of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"]):
            hit = np.zeros(len(t), dtype=bool)
            for x, y in block_pairs(*_sides(t), share, None):
                hit[x] = hit[y] = True
            yield from t.filter(pa.array(hit)).to_batches()

    return rows.mapInArrow(tidy(run), SIDES)


def links_in_blocks(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) by comparing the full sets of all plausible pairs in each pair of blocks.

    Of a set's links to one component within a pair of blocks one is given, as
    it merges the two; so no pairs of a group are ever listed.
    """
    wanted = rows.select(F.col("rep").alias("doc_id")).distinct()
    full = chosen_texts(texts, wanted)
    rows = in_runs(rows.join(full.select(F.col("doc_id").alias("rep"), "text"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"], 512):
            rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
            sets = [s for _, some in shingle_sets(t.column("text"), k) for s in some]
            found = []
            for x, y in block_pairs(*_sides(t), num / den, None):
                for one in np.unique(x):
                    found += [(rep[one], rep[other]) for other in linked(sets, one, y[x == one], comp, num, den)]
            a, b = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    columns = ["key", "i", "j", "side", "band", "rep", "comp", "size", "regs", "text"]
    return rows.select(columns).mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def linked(sets: list[np.ndarray], x: int, others: np.ndarray, comp: np.ndarray, num: int, den: int) -> list[int]:
    """Of the others that are linked with x the first of each component."""
    own = sets[x]
    flat = np.concatenate([sets[y] for y in others])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    sizes = np.array([len(sets[y]) for y in others])
    common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    hits = others[den * common >= num * (len(own) + sizes - common)]
    return hits[np.unique(comp[hits], return_index=True)[1]].tolist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Whole groups of sorted batches, together at least so many rows; the last may be fewer."""
    kept, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in keys])
        turn = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))
        cut = int(turn[-1]) + 1 if len(turn) else 0
        if n >= rows and last is not None and tuple(ids[:, 0]) != last:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, n = [], 0
        if cut and n + cut >= rows:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept, n, batch = [], 0, batch.slice(cut)
        kept.append(batch)
        n += batch.num_rows
        last = tuple(ids[:, -1])
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def block_pairs(group: np.ndarray, side: np.ndarray, band: np.ndarray, comp: np.ndarray, size: np.ndarray, regs: np.ndarray, share: float, first: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the plausible pairs of the two sides within each group of sorted rows.

    With ``first`` only so many for each x and component, the likeliest.
    """
    starts = np.append(0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1)
    of = np.zeros(len(side), dtype=np.int64)
    of[starts[1:]] = 1
    of = np.cumsum(of)
    left = np.bincount(of, weights=side == 0).astype(np.int64)
    right = np.bincount(of).astype(np.int64) - left
    lefts = np.flatnonzero(side == 0)
    pairs = np.cumsum(right[of[lefts]])
    i = 0
    while i < len(lefts):
        j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + PAIRS, side="right")))
        some, i = lefts[i:j], j
        each = right[of[some]]
        x = np.repeat(some, each)
        y = np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[of[some]] + left[of[some]], each)
        ok = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= share * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        a, b = regs[x], regs[y]
        same = a == b
        ok = (same.reshape(len(x), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[x]) & plausible(a, b, size[x], size[y], share, alike := same.sum(axis=1))
        x, y, alike = x[ok], y[ok], alike[ok]
        if first and len(x):
            order = np.lexsort((-alike, comp[y], x))
            x, y = x[order], y[order]
            begin = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (comp[y][1:] != comp[y][:-1])))
            ok = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) < first
            x, y = x[ok], y[ok]
        yield x, y


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if den * |A & B| >= num * |A | B| on their sets of
    distinct k-word shingles (A-Z folded; a shorter text is one shingle).
    component_id is the smallest doc_id reachable.  Null, empty and blank texts
    have the empty set and are linked with nothing; rows with a null id are
    linked with nothing, have a null component and are kept.  Ids may be any of
    bigint.  Texts of any length count whole; a task holds one at a time beside
    its slices.  Repeated rows are exact copies, so each gives the same result.
    Ids tell documents apart: of different texts under one id either may be
    compared, so give such rows ids of their own, as the pipeline does.  No
    rows, no result rows.
    """
    share = num / den
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    known = checkpoint(sketches(texts, k))
    usable = known.where("fp is not null and doc_id is not null")
    reps = checkpoint(usable.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    band_rows = buckets(reps)
    several = band_rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("key")
    shared = checkpoint(band_rows.join(several, "key", "left_semi"))
    comps, forest = None, None
    for step in ("stars", "first", "rest"):
        if step == "stars":
            new = verified(checkpoint(likely(star_pairs(shared), reps, share)), texts, k, num, den)
        else:
            rows = dealt(checkpoint(left_over(shared, comps)), reps)
            if step == "first":
                new = verified(checkpoint(likeliest_pairs(rows, share)), texts, k, num, den)
            else:
                new = links_in_blocks(checkpoint(undecided(rows, share)), texts, k, num, den)
        # The components so far are a forest; new links go on from there.
        forest = connected_components(new if forest is None else new.union(forest.selectExpr("node as a", "component as b")))
        comps = joinable(forest.select(F.col("node").alias("rep"), F.col("component").alias("comp")))
    classes = reps.select("fp", "rep").join(comps, "rep", "left").select("fp", F.coalesce("comp", "rep").alias("class"))
    linkable = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    out = known.where(linkable).select("doc_id", "n", "fp").join(classes, "fp").select("doc_id", "n", "class")
    out = out.union(known.where(~linkable).select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("class"), F.lit(True)).alias("kept"))


def oracle_sql(k: int, num: int, den: int) -> str:
    """DuckDB SQL for ``near_duplicates`` over documents, by brute force."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
