"""Operators on documents against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, license_scan, minhash, mixing, pii, quality_knn, quality_rules, queries, toxicity
from gridloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(40_000))
EDGES = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", None), (4, "one", None), (5, LONG, "b"), (None, "no id at all here", "b"), (6, "x y z " * 9, "b")]
SCHEMA = "doc_id long, text string, source string, n int, regs int, label string, key string, size long"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", "k", 3) for r in EDGES], SCHEMA)


@pytest.mark.parametrize("name", ["op1_minhash", "op2_warc", "op7_license_scan"])
def test_query_equals_sql(name, agree):
    assert agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


def texts(duck):
    return duck.sql("select doc_id, text from documents").fetchall()


def test_quality_counts_by_brute_force(spark, sf_dir, duck):
    got = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, sf_dir).collect()}
    for i, x in texts(duck):
        w = WORD.findall(x or "")
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        often = collections.Counter(windows)
        covered = {k for j, v in enumerate(windows) if often[v] > 1 for k in range(j, j + 8)}
        lines = [x for x in (x or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["kept"] and r["base_failed"])


def test_votes_are_weighed(spark, duck, sf_dir):
    rows = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.99
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.9
    assert quality_rules.fit([])[0][0] > 0.8


@pytest.mark.parametrize("noise", [0.0, 0.35])
def test_noisy_rule_is_found_out(noise):
    """A rule that fires at random on a third of all documents loses its say; the others keep theirs."""
    rng = np.random.default_rng(3)
    defect = rng.choice(8, size=20000, p=[0.86, *[0.02] * 7])
    votes = np.where(rng.random((20000, 7)) < 0.001, -1, 1)
    for r in range(7):
        votes[defect == r + 1, r] = np.where(rng.random((defect == r + 1).sum()) < 0.9, -1, 1)
    votes[rng.random(20000) < noise, 6] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, bad = quality_rules.fit([(tuple(v), int(n)) for v, n in zip(patterns.tolist(), counts)])
    good = lambda *fired: quality_rules.posterior(tuple(-1 if r in fired else 1 for r in range(7)), share, bad)
    assert good() > 0.9 and (good(6) > 0.5) == (noise > 0) and all(good(r) < 0.5 for r in range(6)) and good(0, 6) < 0.5
    assert noise == 0 or 0.15 < bad[0, 6] < 0.4


@pytest.mark.parametrize("x", ["a b c d e f g h a b c d e f g h", "a " * 20, "a b c d e f g h i", "", "p q r s t u v w x " * 2 + "y"])
def test_repeated_words(spark, x):
    w = x.split()
    windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
    covered = {k for j, v in enumerate(windows) if windows.count(v) > 1 for k in range(j, j + 8)}
    row = spark.createDataFrame([(x,)], "t string").select(quality_rules.repeated_words(quality_rules.words_of(F.col("t"))).alias("n")).first()
    assert row["n"] == len(covered)


def test_edges_everywhere(spark, edges):
    """Every operator keeps all rows of the edge cases and of an empty table."""
    train = spark.createDataFrame([("you idiot", 1, 0), ("fine words here", 0, 1)], "text string, toxic int, quality int")
    runs = {
        "quality": lambda d: quality_rules.score_quality(d), "license": lambda d: license_scan.scan_licenses(d), "near": lambda d: minhash.near_duplicates(d),
        "mix": lambda d: mixing.taken_words(d), "pii": lambda d: pii.replace_pii(d, "k"), "bpe": lambda d: bpe.encode_documents(d, queries.vocabulary_path()),
        "knn": lambda d: quality_knn.score_quality(d, train), "toxic": lambda d: toxicity.score_toxicity(d, train, train),
    }
    for name, run in runs.items():
        assert run(edges).count() == len(EDGES), name
        assert run(edges.limit(0)).count() == 0, name


def test_edge_results(spark, edges):
    near = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(edges).collect()]
    assert (1, 0, 1, True) in near and (2, 0, 2, True) in near and near.count((4, 1, 4, True)) == 2 and (None, 1, None, True) in near
    q = {r["doc_id"]: r for r in quality_rules.score_quality(edges).collect()}
    assert q[1]["n_words"] == 0 and q[1]["base_failed"] and not q[2]["kept"] and q[5]["n_words"] == 40_000
    scan = {r["doc_id"]: r for r in license_scan.scan_licenses(edges).collect()}
    assert scan[1]["labels"] == "" and scan[1]["first_word"] is None and scan[1]["score"] == 0.0
    taken = {r["doc_id"]: r for r in mixing.taken_words(edges).collect()}
    assert taken[1]["size"] == 0 and taken[1]["taken"] == 0 and 0 < taken[5]["taken"] <= 2 * 40_000
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(edges, "k").collect()}
    assert out[1] is None and out[5] == LONG and out[2] == ""


def test_templates_found_by_containment(spark):
    block = "Licensed under the Creative Commons Attribution 4.0 licence (international)"
    rows = [(1, f"words\n{block}\nmore"), (2, "released under a licence"), (3, "MIT\nLicense"), (4, "the émit license")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1]["labels"] == "cc" and 0.8 <= got[1]["score"] <= 1 and got[2]["labels"] == ""
    assert got[3]["labels"] == "mit" and got[3]["n_base"] == 1 and got[4]["n_base"] == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(u[:1000]), np.unique(u[111:1111])
    x, y, z = minhash.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(x, y) == z).all()
    est = minhash.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(est - 0.8) < 0.1


def test_near_duplicates_by_brute_force(spark):
    """Groups of near copies with chains, so that members need more than one hub, five-word shingles."""
    rng = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(120)]
        for _ in range(12):
            docs.append(" ".join(base))
            if rng.random() < 0.8:
                base = base.copy()
                at = rng.randrange(len(base))
                base[at] = f"new{rng.randrange(10**6)}"
    docs += [docs[0], docs[5]]
    sets = [shingles(d, 5) for d in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), k=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in range(len(docs))}


def test_targets_and_permutation():
    t = mixing.targets([100, 10, 1000, 50])
    assert abs(sum(t) - 1.5 * 1160) < 1e-9 and all(x <= 2 * s for x, s in zip(t, [100, 10, 1000, 50]))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, dtype=np.uint64))) == list(range(n))


def test_mix_meets_targets_and_agrees_with_its_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.taken_words(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs.repartition(7)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r["source_no"]][0] += r["size"]
        by[r["source_no"]][1] += r["taken"]
        by[r["source_no"]][2] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-6
    assert all(abs(v[1] - v[2]) <= 2 * mixing.BLOCK_WORDS for v in by.values())
    words = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == collections.Counter({k: v for k, v in again.items() if v})
    blocks = mixing.mixed_blocks(docs).collect()
    assert sum(p["words"] for b in blocks for p in b["parts"]) == sum(again.values())


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    own, library = bpe.WordBPE(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "ab'srtvmld éßΣσς İ½²1!?.#\x1c\x85\xa0\t\n日本語😀ǅ́e​"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    cases += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    cases += ["", "a<|endoftext|>B<|startoftext|>", "!" * 3000, "hahaha" * 300, "<|ENDOFTEXT|>"]
    ids, decoded = own.encode_batch(cases)
    for x, i, d, e in zip(cases, ids, decoded, library.encode_batch(cases, add_special_tokens=False)):
        assert i == e.ids and d == library.decode(e.ids, skip_special_tokens=False) == own.decode(i), x
    assert 0 < own.exact < own.seen


def test_bpe_digests(spark, sf_dir, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, sf_dir).collect()}
    for i, x in texts(duck):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op6_toxicity, "toxic", 0.96), (queries.op4_quality_knn, "quality", 0.96)])
def test_held_out_accuracy(spark, query, label, least):
    big = "/root/testdata/sf0.1"
    rows = query(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 500 and np.mean([r["predicted"] == r[label] for r in rows]) > least
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_never_read(spark, sf_dir):
    """Scores stay as they are when the held-out labels are turned round."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumns({c: F.when(toxicity.held_out(mod=m, rest=r), 1 - F.col(c)).otherwise(F.col(c)) for c, m, r in (("toxic", 3, 1), ("quality", 5, 0))})
    one = [toxicity.score_toxicity(docs, *toxicity.training_rows(docs, x)).collect() for x in (labels, turned)]
    assert sorted(map(tuple, one[0])) == sorted(map(tuple, one[1]))
    two = [sorted(map(tuple, quality_knn.score_quality(docs, quality_knn.labelled_rows(docs, x)).collect())) for x in (labels, turned)]
    assert np.allclose([r[1] for r in two[0]], [r[1] for r in two[1]], atol=1e-6)


def test_surrogates(spark):
    text = "Mr. John Smith met Mrs. Anna Bell, Mr. John Smith. Call (212) 555-0199 or 212-555-0199, card 4111 1111 1111 1111, 10.1.2.3, a.b@mail.org and A.B@MAIL.ORG, token = \"abcdef0123456789abcdef0123456789abcdef01\""
    rows = pii.replace_pii(spark.createDataFrame([(1, text), (2, "mail a.b@mail.org"), (3, "plain words: 3 of 12")], "doc_id int, text string"), "key").collect()
    by = {r["doc_id"]: r for r in rows}
    new = by[1]["text"]
    for value in ("John", "Anna", "555-0199", "4111 1111", "10.1.2.3", "a.b@mail.org", "A.B@MAIL.ORG", "abcdef0123"):
        assert value not in new
    male, female = re.findall(r"Mr\. (\w+ \w+)", new), re.findall(r"Mrs\. (\w+ \w+)", new)
    assert len(set(male)) == 1 and len(male) == 2 and female[0].split()[0].endswith("lina") and male[0].split()[0].endswith("rdo")
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", new)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    card = re.sub(" ", "", re.search(r"card ([\d ]{19})", new)[1])
    assert card[0] == "4" and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    mails = re.findall(r"[\w.]+@example\.\w+", new)
    assert len(set(mails)) == 1 and mails[0] in by[2]["text"]
    assert re.search(r'token = "[0-9a-f]{40}"', new) and by[3]["text"] == "plain words: 3 of 12" and by[3]["n_entities"] == 0


def test_surrogates_stay_distinct(spark):
    few = spark.range(400).select(F.lit("email").alias("kind"), F.concat(F.col("id").cast("string"), F.lit("@x.co")).alias("canonical"))
    got = pii.assign(few, "key")
    assert got.select("surrogate").distinct().count() == 400 == got.count()


def test_shingle_hashes_equal_words():
    from gridloom.llm.textnum import shingle_sets

    cases = ["A b  c\n d", "a B c d", None, "", "one", "é É x", " lead", "a b c d a b c d", "x" * 3000]
    out = {}
    for row, sets in shingle_sets(pa.array(cases), 2):
        out.update(enumerate(sets, row))
    want = [shingles((c or "").encode().lower().decode() if c and c.isascii() else (c or ""), 2) for c in cases]
    assert [len(out[i]) for i in range(len(cases))] == [len(w) for w in want]
    assert (out[0] == out[1]).all()
