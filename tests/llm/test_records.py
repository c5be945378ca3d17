"""Archive records, vectors, components and the pipeline."""

import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, nn_descent, queries, warc


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("part", [500_000, 7])
@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, monkeypatch, n, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(n)
    least, most = -(1 << 63), (1 << 63) - 1
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(n)] + [(i, i + 1) for i in range(100, 100 + n)]
    edges += [(least, most), (most - 1, most - 2), (least + 1, least + 2), (most - 2, least + 2)] * n
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    rows = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(rows).collect()}
    assert got == {x: root(x) for x in linked}


def test_revisits(spark):
    r = lambda i, url, s, kind, headers, body=None: (i, url, s, kind, headers, body)
    rows = [
        r("a", "http://www.x.org/p/?b=1&a=2&utm_source=z#f", 10, "response", {"etag": '"1"', "content-length": "5", "age": "1"}, b"first"),
        r("b", "https://X.org:443/p?a=2&b=1", 20, "response", {"etag": '"2"'}, b"second"),
        r("c", "https://x.org/p?a=2&b=1", 20, "revisit", {"etag": 'W/"1"', "content-length": "0", "age": "9", "connection": "close"}),
        r("d", "https://x.org/p?a=2&b=1", 21, "revisit", {"etag": '"1"'}), r("e", "https://x.org/p?a=2&b=1", 22, "revisit", {}), r("f", "https://x.org/q", 30, "revisit", None),
        r("g", None, 30, "revisit", {}), r("h", "https://x.org/p?a=2&b=1", None, "revisit", {}), r("i", "https://x.org/", 5, "request", {}), r(None, "https://x.org/", 5, "revisit", {}),
        r("e", "https://x.org/p?a=2&b=1", 22, "revisit", {}),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, s long, type string, headers map<string,string>, body binary").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["record_id"]: x for x in warc.resolve_revisits(df).collect()}
    assert {k: (v["status"], v["response_id"]) for k, v in got.items()} == {"c": ("resolved", "a"), "d": ("stale", "b"), "e": ("unverified", "b"), "f": ("missing", None), "g": ("missing", None), "h": ("missing", None), None: ("missing", None)}
    assert got["c"]["headers"] == {"etag": 'W/"1"', "content-length": "5", "age": "9"} and bytes(got["c"]["body"]) == b"first" and got["d"]["body"] is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_slots_of_time_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(str(i), f"u{rng.randrange(3)}", rng.randrange(400), rng.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id string, url_key string, ts long, full boolean")
    want = {}
    for i, u, t, full in rows:
        if not full:
            found = max(((b, a) for a, v, b, f in rows if f and v == u and b < t), default=(0, None))
            want[i] = found[1]
    for size in (3, 20, 100_000):
        monkeypatch.setattr(warc, "FAN", size)
        found = {(r["url_key"], r["ts"]): r["response_id"] for r in warc.latest_earlier(df).collect()}
        assert {i: found[u, t] for i, u, t, full in rows if not full} == want


def test_repeated_and_missing_ids(spark):
    rows = [("a", "http://x.org/", 10, "response", b"one"), ("a", "http://x.org/", 10, "response", b"one"), ("a", "http://x.org/", 9, "response", b"earlier"), (None, "http://x.org/", 12, "response", b"nameless")]
    rows += [("b", "http://x.org/", 20, "revisit", None), ("b", "http://x.org/", 5, "revisit", None), (None, "http://x.org/", 20, "revisit", None), (None, "http://x.org/", 20, "revisit", None)]
    df = spark.createDataFrame(rows, "record_id string, url string, s long, type string, body binary").withColumn("ts", F.timestamp_seconds("s")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    got = sorted((str(r["record_id"]), r["response_id"], r["body"] and bytes(r["body"])) for r in warc.resolve_revisits(df).collect())
    assert got == [("None", "a", b"earlier"), ("None", "a", b"earlier"), ("b", None, None)]


def test_broken_archives(spark, tmp_path):
    record = lambda i, length: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {length}\r\n\r\nhello\r\n\r\n".encode()
    good = record("a", 5)
    assert [(r["record_id"], r["body"]) for r in warc.parse_records(good + record("b", "many") + record("c", -1) + record("d", 5))] == [("<a>", b"hello"), ("<b>", b""), ("<c>", b""), ("<d>", b"hello")]
    packed = gzip.compress(good) + gzip.compress(record("b", 5) * 50)
    assert [r["record_id"] for r in warc.parse_records(packed[: len(gzip.compress(good)) + 30])][:1] == ["<a>"]
    assert list(warc.parse_records(b"")) == [] and [r["body"] for r in warc.parse_records(record("a", 500))] == [b"hello\r\n\r\n"]
    for name, data in (("empty", b""), ("noise", bytes(range(256))), ("cut", packed[:-9]), ("good", good)):
        (tmp_path / name).write_bytes(data)
    assert warc.read_warc(spark, str(tmp_path)).where("record_id = '<a>'").count() == 2


@pytest.mark.parametrize("packed", [False, True])
def test_reading_archives(spark, tmp_path, packed):
    http = b'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\nhello'
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://x.org/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n"
    one = head + f"Content-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"
    data = gzip.compress(one) + gzip.compress(one.replace(b"<a>", b"<b>")) if packed else one + one.replace(b"<a>", b"<b>")
    (tmp_path / "x.warc").write_bytes(data)
    got = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r["record_id"])
    assert [(r["record_id"], bytes(r["body"]), r["headers"]["etag"], r["ts"].year) for r in got] == [("<a>", b"hello", '"1"', 2020), ("<b>", b"hello", '"1"', 2020)]


def vectors():
    rng = np.random.default_rng(2)
    x = [rng.standard_normal(16) for _ in range(150)]
    for size in (2, 5, 40):
        base = rng.standard_normal(16)
        x += [base + rng.standard_normal(16) * 0.12 for _ in range(size)]
    x += [x[3], x[3] * 7, -x[3]]
    return [v.astype(np.float32) for v in x]


def test_vectors_by_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in nn_descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.stack(x).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    comp = list(range(len(x)))
    for _ in range(60):
        comp = [min(comp[j] for j in np.flatnonzero(linked[i])) for i in range(len(x))]
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[i].sum() - 1, comp[i], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904)) and got[906]["component_id"] == 905 and got[None]["kept"]


def test_descent_mends_poor_seeds(spark, monkeypatch):
    """With one table of narrow buckets the rounds have to find most links."""
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "BUCKET", 8)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = np.stack(x).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum() - len(x)
    found = sum(r["n_links"] for r in nn_descent.near_vectors(df).collect())
    assert 0.9 * true <= found <= true
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def one_of_each_group(rows):
    """Brute force: the least id of each group of texts linked by five-word shingles of similarity 0.8 or more."""
    sets = {}
    for r in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0]
    while True:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            return set(least.values())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    spark.conf.set("spark.gridloom.pii.key", "the tests' key")
    assert [n for n, _ in p.STAGES] == ["toxicity", "minhash_near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, sf_dir).collect()}
    one = p.drop_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, s in scores.items() if s < p.TOXIC_AT}
    two = p.drop_near_duplicates(spark, one, sf_dir)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == one_of_each_group(one.collect())
    three = p.replace_private(spark, two, sf_dir)
    assert three.columns == docs.columns and three.count() == two.count() and three.where("text rlike '@mail[0-9].example.com'").count() == 0
    four = p.mix_sources(spark, three, sf_dir)
    assert four.columns == docs.columns and four.where("n_chars != length(text)").count() == 0
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    mixed = four.collect()
    assert {r["doc_id"] for r in mixed} <= set(texts) and max(collections.Counter(r["doc_id"] for r in mixed).values()) <= 2
    assert all(set(WORD.findall(r["text"])) <= set(WORD.findall(texts[r["doc_id"]])) for r in mixed)
    library = Tokenizer.from_file(queries.vocabulary_path())
    want = []
    for r in mixed:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((r["doc_id"], len(ids), *digests))
    assert sorted(tuple(r) for r in p.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_pipeline_edges(spark, sf_dir):
    import corpus_pipeline as p

    same, other = " ".join(f"word{i}" for i in range(40)) + " ", "another text under an id that is taken " * 9
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (None, "some words without an id", None, "a", 3), (None, same + "and", "en", "b", 1)]
    rows += [(4, same, "en", "b", 1), (4, same, "en", "b", 1), (5, same, "en", "b", 1), (5, other, "en", "b", 1), ((1 << 63) - 1, "mail me at jane@corp.example.net", "en", "b", 1), (-(1 << 63), "mail me at jane@corp.example.net now", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda x: sorted(map(str, ((r["doc_id"], r["text"]) for r in x.collect())))
    one = p.drop_toxic(spark, docs, sf_dir)
    assert got(one) == got(docs)
    two = p.drop_near_duplicates(spark, one, sf_dir)
    want = [r[:2] for i, r in enumerate(rows) if i not in (3, 5, 6)]
    assert got(two) == sorted(map(str, want))
    three = p.replace_private(spark, two, sf_dir)
    clean = [r for r in want if "@" not in (r[1] or "")]
    assert set(map(str, clean)) < set(got(three)) and three.count() == len(want) and three.where("text like '%jane@%'").count() == 0
    four = p.mix_sources(spark, three, sf_dir)
    words = {w for r in three.collect() for w in WORD.findall(r["text"] or "")}
    assert all(r["text"] and set(WORD.findall(r["text"])) <= words for r in four.collect())
    five = p.encode(spark, four, sf_dir)
    assert sorted(str(r["doc_id"]) for r in five.collect()) == sorted(str(r["doc_id"]) for r in four.collect())
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
