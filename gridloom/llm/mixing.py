"""Mixing sources to target weights in fixed-length blocks.

Each source's documents, in a fixed pseudorandom order, form one stream of
words that is cut into blocks.  Output shards draw how many slots each source
gets: multinomial draws conditioned on the mix's exact totals (that is,
multivariate hypergeometric ones), so every source meets its target to within a
block.  A source's slots are numbered through; slot numbers are mapped to block
indexes by a keyed permutation of the source's blocks, a new one for each pass,
and blocks are joined to slots by index.  No block is taken more than twice.

Only per-source totals reach the driver, at most ``MAX_SOURCES`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, tidy
from .textnum import mix

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 256
#: Shards whose slots one task draws together.
GROUP_SHARDS = 64
#: Documents whose offsets are summed in one go, and runs of them.
RUN, RUNS = 200, 1000
MAX_SOURCES = 100_000


def targets(sizes: list[int], share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """What each source is to give: shares by weight, none above ``most`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = rest / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
        open_ -= over
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n[i]), at index[i]: a Feistel network with cycle walking."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mix(right + k * np.uint64(2 * turn + 1)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, key, source, size): key tells apart rows of one id with different texts."""
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def plan(rows: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the stream, taken slots) for rows of ``sized``.

    documents: doc_id, key, source, size, source_no, source_size, target, start.
    slots: shard, slot, source_no, copy, block.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes)
    blocks = [-(-s // BLOCK_WORDS) for s in sizes]
    quota = np.array([round(t * b / s) if s else 0 for t, s, b in zip(goal, sizes, blocks)], dtype=np.int64)
    table = [(r["source"], i, r["size"], float(goal[i]), -(-r["n"] // RUN)) for i, r in enumerate(totals)]
    kinds = {"name": pa.string(), "source_no": pa.int32(), "source_size": pa.int64(), "target": pa.float64(), "runs": pa.int64()}
    # From Arrow, as rows of Python would start workers of another kind, which stay beside those of the operators.
    sources = spark.createDataFrame(pa.table([pa.array([r[i] for r in table], type=kind) for i, kind in enumerate(kinds.values())], names=list(kinds)))
    placed = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), "runs"))
    before = placed.groupBy("source_no", "run").agg(F.sum("size").alias("words")).withColumn("part", F.expr(f"run div {RUNS}"))
    earlier = lambda by, order: F.sum("words").over(Window.partitionBy(*by).orderBy(order)) - F.col("words")
    parts = before.groupBy("source_no", "part").agg(F.sum("words").alias("words")).select("source_no", "part", earlier(["source_no"], "part").alias("base"))
    before = before.withColumn("within", earlier(["source_no", "part"], "run")).join(parts, ["source_no", "part"]).select("source_no", "run", (F.col("base") + F.col("within")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("source_no", "run").orderBy("doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, ["source_no", "run"])
    documents = placed.select("doc_id", "key", "source", "size", "source_no", "source_size", "target", (F.col("base") + F.col("inner")).alias("start"))
    return documents, slots(spark, quota, np.array(blocks, dtype=np.int64), seed)


def slots(spark, quota: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    """(shard, slot, source_no, copy, block) of the whole mix."""
    groups = int(-(-quota.sum() // (SHARD_SLOTS * GROUP_SHARDS)))

    def draw(g: int) -> tuple[np.ndarray, ...]:
        low, high = quota * g // groups, quota * (g + 1) // groups
        rng = np.random.default_rng([seed, g])
        left, at, out = high - low, low.copy(), []
        shard = 0
        while left.sum():
            got = rng.multivariate_hypergeometric(left, min(SHARD_SLOTS, int(left.sum())), method="marginals")
            source = np.repeat(np.arange(len(got)), got)
            ordinal = np.concatenate([np.arange(a, a + n) for a, n in zip(at, got)])
            order = rng.permutation(len(source))
            out.append((np.full(len(source), g * (GROUP_SHARDS + 1) + shard), np.arange(len(source)), source[order], ordinal[order]))
            left, at, shard = left - got, at + got, shard + 1
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                shard, slot, source, ordinal = draw(g)
                n = blocks[source]
                copy = ordinal // n
                with np.errstate(over="ignore"):
                    key = mix((source.astype(np.uint64) << np.uint64(32)) + copy.astype(np.uint64) + mix(np.full(len(source), seed, dtype=np.uint64)))
                block = permuted(ordinal % n, n, key)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (shard, slot, source, copy, block)], ["shard", "slot", "source_no", "copy", "block"])

    schema = "shard long, slot long, source_no long, copy long, block long"
    if not groups:
        return spark.createDataFrame([], schema)
    return spark.range(0, groups, 1, max(1, min(groups, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(tidy(run), schema)


def pieces(documents: DataFrame) -> DataFrame:
    """The documents' parts by block: adds block, words; documents without words have none."""
    last = F.expr(f"(start + size - 1) div {BLOCK_WORDS}")
    cut = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK_WORDS}"), last)))
    begin, end = F.col("block") * BLOCK_WORDS, (F.col("block") + 1) * BLOCK_WORDS
    return cut.withColumn("words", F.least(end, F.col("start") + F.col("size")) - F.greatest(begin, F.col("start")))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: (shard, slot, source_no, copy, block, parts), a row for each slot.

    ``parts`` lists the documents in the block: doc_id, the first word's number
    in the document and the number of words.  Null and empty texts are in no
    block, long ones in many; null sources, null ids and repeated rows are as in
    ``taken_words``.  An empty table gives no slots.
    """
    documents, taken = plan(checkpoint(sized(docs, id_col, text_col, source_col)), seed)
    part = F.struct("start", "doc_id", F.greatest(F.col("block") * BLOCK_WORDS - F.col("start"), F.lit(0)).alias("first_word"), "words")
    parts = pieces(documents).groupBy("source_no", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return taken.hint("merge").join(parts.withColumn("source_no", F.col("source_no").cast("long")), ["source_no", "block"])


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, key, source_no, start, size, source_size, target, taken, counts) of every row.

    ``taken`` is the number of the document's words in the mix, repeats counted;
    ``counts`` says for each of its blocks how often the mix takes it.  Null and
    empty texts have size 0 and are never taken (null counts).  A null source is
    a source of its own, after all others.  Null ids and repeated rows are
    documents like others.  An empty table gives an empty result.
    """
    documents, taken = plan(checkpoint(sized(docs, id_col, text_col, source_col)), seed)
    used = taken.groupBy(F.col("source_no").cast("int").alias("source_no"), "block").agg(F.count("*").alias("times"))
    columns = ["doc_id", "key", "source_no", "source_size", "target", "start", "size"]
    # Slots grow with the data though they come from a short range, so Spark must not take them for small.
    cut = pieces(documents).join(used.hint("merge"), ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    some = cut.groupBy(columns).agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.transform(F.array_sort(F.collect_list(F.struct("block", "times"))), lambda x: x["times"]).alias("counts"))
    none = documents.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<bigint>").alias("counts"))
    return some.union(none)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix as documents: all columns of ``docs`` with the text's taken blocks.

    A document taken whole keeps its text as it is; one taken in part keeps the
    words of its taken blocks, each with the white space after it.  Blocks taken
    a second time make a second row with the same id.  Documents of which the
    mix takes nothing, those without words among them, have no row.
    """
    text = F.col(text_col)
    twin = lambda *order: F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    key = lambda i, h: F.struct(F.col(i).alias("id"), h.alias("hash")).alias("__key")
    taken = taken_words(docs, id_col, text_col, source_col, seed).where("taken > 0")
    taken = taken.select(key("doc_id", F.col("key")), F.col("start").alias("__start"), F.col("counts").alias("__counts")).withColumn("__twin", twin("__start"))
    rows = docs.withColumn("__key", key(id_col, F.xxhash64(F.col(id_col), text))).withColumn("__twin", twin(F.lit(0)))
    both = rows.join(taken, ["__key", "__twin"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max("__counts"))))
    place = lambda i: F.floor((F.col("__start") + i) / BLOCK_WORDS) - F.floor(F.col("__start") / BLOCK_WORDS)
    chosen = F.filter(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), lambda w, i: F.get(F.col("__counts"), place(i).cast("int")) >= F.col("__copy"))
    return both.withColumn(text_col, F.when(F.array_min("__counts") >= F.col("__copy"), text).otherwise(F.array_join(chosen, ""))).drop("__key", "__twin", "__start", "__counts", "__copy")
