"""Byte-level BPE with word ends: speculate, verify, and merge only what fails.

For words not met before, greedy longest match proposes tokens.  A sequence of
tokens is what merging in rank order gives if and only if every adjacent pair
is compatible, that is, merging the two tokens' text gives just these two.  The
test of all pairs of all words runs as NumPy steps on arrays that take the
tokens apart; only words with an incompatible pair (or without a proposal) are
merged exactly, with a heap.

The vocabulary file is a parameter, in the ``tokenizers`` JSON layout with NFC,
white space and lower-case normalisers, the split pattern below, byte-level
letters, a word-end suffix and no decoder (decoding joins tokens by a space).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy, worker_cache

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A character that is no byte letter, for the word end.
END = "\ue000"
BATCH_BYTES = 1 << 20
NEVER = 1 << 40
#: Bytes, about, of one generation of the cache; two generations are kept.
CACHE = 48 << 20
#: Bytes, about, that a cached piece takes beside its letters and ids.
ENTRY = 170
#: Words of more bytes are merged one by one.
LONG = 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for one vocabulary file's content."""

    def __init__(self, content: str, cache: int = CACHE):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model.get("dropout") or spec.get("decoder"):
            raise ValueError("not a BPE vocabulary with word ends and without a decoder")
        suffix = lambda t: t[:-4] + END if t.endswith("</w>") else t
        self.vocab = {suffix(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.longest: dict[str, int] = {}
        for t in self.vocab:  # by their first four letters, so that few lengths are tried in vain
            if len(t) > 3:
                self.longest[t[:4]] = max(self.longest.get(t[:4], 0), len(t))
        n = self.size = max(self.tokens) + 1
        self.rank, self.left, self.right = np.full(n, -1), np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = self.vocab[suffix(a)], self.vocab[suffix(b)]
            z = self.vocab[suffix(a) + suffix(b)]
            if self.rank[z] >= 0:
                raise ValueError("two merges give one token")
            self.rank[z], self.left[z], self.right[z] = r, x, y
            self.merges[x, y] = (r, z)
        keys = np.array([x * n + y for x, y in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order], 0)
        self.result = np.array([z for _, z in self.merges.values()], dtype=np.int32)  # in rank order
        self.letters = dict(enumerate(byte_letters()))
        self.base = np.array([[self.vocab[c + end] for c in byte_letters()] for end in ("", END)], dtype=np.int32)
        self.split = regex.compile(SPLIT)
        self.spaces = regex.compile(r"\s+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.new: dict[str, bytes] = {}  # pieces and their ids, as bytes of this kind
        self.old: dict[str, bytes] = {}
        self.cache = cache
        self.held = self.exact = self.seen = 0

    # Words -----------------------------------------------------------------

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match, or None where no token fits."""
        out, i, n, known, longest = [], 0, len(word), self.vocab.get, self.longest.get
        while i < n:
            for j in range(min(n, i + longest(word[i : i + 4], 3)), i, -1):
                if (t := known(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of tokens a[i] and b[i] leaves the two apart."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            keys = x.astype(np.int64) * self.size + y
            at = np.searchsorted(self.pair_keys, keys)
            clash = (self.pair_keys[at] == keys) & (self.pair_ranks[at] < limit[live])
            ok[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ~((rx < 0) & (ry < 0))
            first = go & (rx > ry)
            second = go & ~first
            limit[live[first]], a[live[first]] = rx[first], self.right[x[first]]
            limit[live[second]], b[live[second]] = ry[second] + 1, self.left[y[second]]
            live = live[go]
        return ok

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or NEVER."""
        keys = x.astype(np.int64) * self.size + y
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (x >= 0) & (y >= 0), self.pair_ranks[at], NEVER)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merging in rank order, leftmost first, one merge of all words at a time."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        place = np.arange(width)
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[place < sizes[:, None]] = self.base[0][np.frombuffer(b"".join(words), dtype=np.uint8)]
        ids[np.arange(len(words)), sizes - 1] = self.base[1][[w[-1] for w in words]]
        rank = np.full(ids.shape, NEVER, dtype=np.int64)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(words)), [()] * len(words)
        while len(rows):
            j = rank.argmin(axis=1)
            each = np.arange(len(rows))
            best = rank[each, j]
            live = best < NEVER
            for r, t in zip(rows[~live].tolist(), ids[~live].tolist()):
                done[r] = tuple(x for x in t if x >= 0)
            rows, ids, rank, j, best = rows[live], ids[live], rank[live], j[live], best[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            ids[each, j] = self.result[best]
            shift = np.minimum(place + (place > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            rank = np.take_along_axis(rank, shift, axis=1)
            ids[:, -1], rank[:, -1] = -1, NEVER
            for k, some in ((j - 1, j > 0), (j, j < width - 1)):
                at = each[some]
                rank[at, k[some]] = self.ranks(ids[at, k[some]], ids[at, k[some] + 1])
        return done

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact merging of one word of any length."""
        ids: list[int | None] = [*self.base[0][list(word[:-1])].tolist(), int(self.base[1][word[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*m, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (m := self.merges.get((x, y)))]
        heapq.heapify(heap)
        while heap:
            _, z, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (*m, p, ids[p], ids[q]))
        return tuple(t for t in ids if t is not None)

    def learn(self, words: list[str]) -> None:
        """Encode new words."""
        if not words:
            return
        letters = self.letters
        proposals = [self.propose((w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters)) + END) for w in words]
        flat = np.fromiter(chain.from_iterable(p or () for p in proposals), dtype=np.int64)
        sizes = np.array([len(p or ()) for p in proposals])
        word = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, dtype=np.int64)
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back]
        failing = {*word[inner[~good]].tolist(), *(i for i, p in enumerate(proposals) if p is None)}
        self.seen += len(words)
        self.exact += len(failing)
        raw = {i: words[i].encode() for i in failing}
        short = sorted((i for i, w in raw.items() if len(w) <= LONG), key=lambda i: len(raw[i]))
        exact = {i: self.merge(w) for i, w in raw.items() if len(w) > LONG}
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            exact.update(zip(part, self.merge_many([raw[i] for i in part])))
        self.keep(dict(zip(words, self.packed([exact[i] if i in exact else p for i, p in enumerate(proposals)]))))

    def packed(self, many: list[Sequence[int]]) -> list[bytes]:
        """Lists of ids as bytes."""
        flat = np.fromiter(chain.from_iterable(many), dtype=self.kind).tobytes()
        ends = (np.cumsum([0, *map(len, many)]) * self.kind.itemsize).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def keep(self, found: dict[str, bytes]) -> None:
        """Take pieces and their ids into the cache's newer generation."""
        self.new.update(found)
        self.held += ENTRY * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    # Texts -----------------------------------------------------------------

    def chunks_of(self, text: str) -> list[str]:
        """Lower-case pieces between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split only
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def prepare(self, chunks: set[str]) -> None:
        """Have every chunk's token ids in the newer generation of the cache."""
        if self.held > self.cache:
            self.old, self.new, self.held = self.new, {}, 0
        new, old = self.new, self.old
        missing = chunks - new.keys()
        self.keep({c: old[c] for c in missing & old.keys()})
        unknown = missing - old.keys()
        split = self.split.findall
        cut = {c: split(c) for c in unknown if not (c.isascii() and c.isalpha())}
        words = {w for ws in cut.values() for w in ws}
        words.update(c for c in unknown if c not in cut)
        self.learn([w for w in words if w not in new])
        self.keep({c: b"".join([new[w] for w in ws]) for c, ws in cut.items() if len(ws) != 1})

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Token ids and decoded text of each text."""
        ids, decoded = self.encode_arrays(texts)
        return [i.tolist() for i in ids], decoded

    def encode_arrays(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """``encode_batch`` with ids as arrays."""
        pieces = []
        for t in texts:
            parts = self.cut.split(t) if self.cut and "<|" in t else [t]
            pieces.append([p if i % 2 else self.chunks_of(p) for i, p in enumerate(parts)])
        self.prepare({c for ps in pieces for p in ps if isinstance(p, list) for c in p})
        known, token = self.new.__getitem__, self.tokens.__getitem__
        special = {p: self.packed([[i]])[0] for p, i in self.special.items()}
        ids, decoded = [], []
        for ps in pieces:
            found = b"".join([special[p] if isinstance(p, str) else b"".join(map(known, p)) for p in ps])
            ids.append(np.frombuffer(found, dtype=self.kind))
            decoded.append(" ".join(map(token, ids[-1].tolist())))
        return ids, decoded

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, token_ids array<int>, decoded string) of every whole text.

    ``vocabulary`` is the path of a vocabulary file on the driver; its content
    travels in the task closure (a fixed file of a few MB).  Null texts count
    as empty: no ids and an empty decoded text.  A text of any length is encoded
    whole, by itself where it exceeds ``batch_bytes``.  Ids are carried through as
    they are, null or repeated; an empty table gives an empty result.  A smaller
    ``cache`` (as CACHE) or batch takes less memory and more time; results are equal.
    """
    with open(vocabulary, encoding="utf-8") as f:
        read = f.read()
    stamp = hashlib.sha256(read.encode()).hexdigest()
    content = docs.sparkSession.sparkContext.broadcast(read)
    ids = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_cache("bpe", (stamp, cache), lambda: WordBPE(content.value, cache))
        for whole in batches:
            for batch in _pieces(whole, batch_bytes):
                found, decoded = bpe.encode_arrays([t or "" for t in batch.column("text").to_pylist()])
                offsets = np.cumsum([0, *map(len, found)])
                flat = pa.array(np.concatenate(found).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, type=pa.string())], ["doc_id", "token_ids", "decoded"])

    kind = dict(ids.dtypes)["doc_id"]
    return ids.mapInArrow(tidy(run, "bpe"), f"doc_id {kind}, token_ids array<int>, decoded string")


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + size, side="right")))
        yield batch.slice(i, j - i)
        i = j
