"""Cases beyond the given tables in which an operator must still do its whole job."""

import collections
import math
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import bpe, common, license_scan, mixing, nn_descent, pii, queries, toxicity


def pairs(n, others, dim=32, seed=5):
    """n isolated pairs of cosine near 0.955 among random vectors."""
    rng = np.random.default_rng(seed)
    base, noise = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    return np.vstack([base, base + noise * 0.31, rng.standard_normal((others, dim))])


def links(spark, x):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_vectors(rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    return np.array([got[i] for i in range(len(x))]), true


@pytest.mark.parametrize("rounds", [1, 2])
def test_poor_recall_is_not_returned(spark, monkeypatch, rounds):
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "BUCKET", 1)
    monkeypatch.setattr(nn_descent, "SLICE", 300, raising=False)
    monkeypatch.setattr(nn_descent, "ROUNDS", rounds)
    monkeypatch.setattr(nn_descent, "tables_for", lambda bits, threshold: 1, raising=False)
    got, true = links(spark, pairs(300, 300))
    assert true.sum() > 200 and got.sum() >= nn_descent.RECALL * true.sum() and (got <= true).all()


def test_tables_grow_with_the_buckets():
    near = 1 - np.arccos(0.95) / np.pi
    for bits in (1, 8, 11, 20):
        assert (1 - near**bits) ** nn_descent.tables_for(bits, 0.95) <= 1 - nn_descent.RECALL


def test_hot_group_does_not_hide_missed_pairs(spark):
    rng = np.random.default_rng(1)
    hot = rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.02
    x = np.vstack([pairs(20, 20), hot])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, bytearray(v.tobytes()), 1, i if i < 60 else 60) for i, v in enumerate(u)]  # no pair is found, the hot group is
    located = spark.createDataFrame(rows, "rep long, vec binary, n long, comp long")
    assert nn_descent.audit(located, 0.95) < 0.1
    mended = located.selectExpr("rep", "vec", "n", "if(rep >= 20 and rep < 40, rep - 20, comp) as comp")
    assert nn_descent.audit(mended, 0.9) > 0.99
    assert nn_descent.audit(located.limit(0), 0.95) == 1.0


def test_wrapped_licenses_are_found(spark):
    """Each template, wrapped at several widths and behind comment signs, gets the label that it gets on one line."""
    rows, want = [], {}
    for label, t in license_scan.TEMPLATES:
        for width in (0, 20, 35, 72):
            wrapped = "\n# ".join(textwrap.wrap(t, width)) if width else t
            want[len(rows)] = label
            rows.append((len(rows), f"some words here\n# {wrapped}\nand other words"))
    n = len(rows)
    rows.append((n, "redistribution of food\nand use of water in\n" + "plain words\n" * 40 + "source of the\nriver without modification"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i in range(0, n, 4):
        assert want[i] in got[i]["labels"].split(",")
        assert {(got[i + k]["labels"], got[i + k]["score"]) for k in range(4)} == {(got[i]["labels"], 1.0)}, rows[i + 1]
    assert got[n]["labels"] == "" and got[n]["score"] == 0.0


def test_large_vocabularies_keep_words_apart(spark):
    """A word seen in toxic texts alone keeps its counts among a million others."""
    plain = [(" ".join(f"{i * 5000 + k:x}q" for k in range(5000)), 0) for i in range(200)]
    toxic = [(f"{j:x}q vilest{k}", 1) for k in range(8) for j in range(12)]
    train = spark.createDataFrame(plain + toxic, "text string, toxic int").repartition(8)
    gathered = toxicity.gather(train)
    entries = toxicity.with_prefixes(gathered)
    model = toxicity.Model(toxicity.Entries(toxicity.telling(entries).toArrow()), toxicity.totals(gathered, entries))
    _, _, before, w = next(toxicity.tokens(pa.array([" ".join(f"vilest{k}" for k in range(8)) + " neverseenatall"])))
    ratios = model.ratios(before, w)
    assert np.ptp(ratios[:8]) < 1e-9 and (ratios[:8] > 1).all() and ratios[8] == 0


TOXIC_TRAIN = [("you utter fool " * 3, 1), ("what a fool", 1), ("an utter fool and a liar", 1), ("The fool, utter fool", 1), ("a day at sea", 0), ("what a day", 0), ("a day, an utter joy", 0), ("the sea and a day " * 5, 0), ("", 0), ("a day at home", 0), ("foolish fools fooling", 1)]


def ratios_by_brute_force(rows, text):
    """Each word's log ratio from dictionaries of strings."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    pairs, before, begin = ([collections.Counter(), collections.Counter()] for _ in range(3))
    seen = [collections.defaultdict(set), collections.defaultdict(set)]
    for t, label in rows:
        w = words(t)
        held = set(zip(["<start>", *w], w))
        pairs[label].update(held)
        for h, x in held:
            seen[label][x].add(h)
    for c in (0, 1):
        before[c] = {x: len(hs) for x, hs in seen[c].items()}
        for x in seen[c]:
            for n, _ in toxicity.PREFIXES:
                begin[c][n, x.encode()[:n]] += 1

    def level(p, counts, key, total):
        scale = (max(total[1], 1) / max(total[0], 1), 1.0)
        left = [max(counts[c].get(key, 0) - toxicity.DISCOUNT, 0) * scale[c] for c in (0, 1)]
        below = toxicity.STRENGTH + sum(toxicity.DISCOUNT * scale[c] * (left[c] > 0) for c in (0, 1)) / 2
        return [(left[c] + below * p[c]) / (sum(left) / 2 + below) for c in (0, 1)]

    out, w = [], words(text)
    for h, x in zip(["<start>", *w], w):
        p = [1.0, 1.0]
        for n, _ in toxicity.PREFIXES:
            p = level(p, begin, (n, x.encode()[:n]), [sum(v for (m, _), v in begin[c].items() if m == n) for c in (0, 1)])
        p = level(p, before, x, [sum(before[c].values()) for c in (0, 1)])
        p = level(p, pairs, (h, x), [sum(pairs[c].values()) for c in (0, 1)])
        out.append(math.log(p[1]) - math.log(p[0]))
    return out


def test_likelihood_ratios_by_brute_force(spark):
    train = spark.createDataFrame(TOXIC_TRAIN * 2 + [("", 1)], "text string, toxic int").repartition(3)
    gathered = toxicity.gather(train)
    entries = toxicity.with_prefixes(gathered)
    model = toxicity.Model(toxicity.Entries(toxicity.telling(entries).toArrow()), toxicity.totals(gathered, entries))
    text = "What an UTTER fool, fools at sea a day a fool neverseen"
    _, _, before, w = next(toxicity.tokens(pa.array([text])))
    want = ratios_by_brute_force(TOXIC_TRAIN * 2 + [("", 1)], text)
    assert np.allclose(model.ratios(before, w), want, atol=1e-6) and max(want) > 0.5 and min(want) < -0.3


@pytest.mark.parametrize("most", [0, 5])
def test_joined_entries_give_the_same_scores(spark, most):
    train = spark.createDataFrame(TOXIC_TRAIN * 2, "text string, toxic int")
    docs = spark.createDataFrame([(i % 9, t) for i, (t, _) in enumerate(TOXIC_TRAIN)] + [(1, None), (None, "utter fool"), (None, "utter fool")], "doc_id int, text string")
    scores = [sorted(map(str, toxicity.score_toxicity(docs, train, train, broadcast_entries=n).selectExpr("doc_id", "round(score, 9)").collect())) for n in (10**6, most)]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()


def test_texts_are_not_shuffled_for_large_models(spark, monkeypatch):
    """However many entries there are, documents are scored where they are read, each portion as often as blocks ask."""
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 20, raising=False)
    train = spark.createDataFrame(TOXIC_TRAIN * 6, "text string, toxic int")
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, (t, _) in enumerate(TOXIC_TRAIN * 20)], "doc_id int, text string")
    some, whole = (toxicity.score_toxicity(docs, train, train, broadcast_entries=n) for n in (9, 10**6))
    assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(some.collect()) == sorted(whole.collect())


def test_names_stay_one_person_in_a_document(spark):
    text = "Mr John Smith came. John Smith sat, Smith spoke, Mr. Smith left; Smith's hat. Mrs Smith and Smithson stayed."
    rows = [(1, text), (2, "Smith and John Smith, untitled"), (3, "Frau Müller sah Müller."), (4, None)]
    got = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), "key").collect()}
    new = got[1]["text"]
    first, last = re.match(r"Mr (\w+) (\w+) came", new).groups()
    other = re.search(r"Mrs (\w+) and", new)[1]
    assert new == f"Mr {first} {last} came. {first} {last} sat, {last} spoke, Mr. {last} left; {last}'s hat. Mrs {other} and Smithson stayed."
    assert got[1]["n_entities"] == 6 and other not in (last, "Smith") and "Smith" != last
    assert got[2]["text"] == rows[1][1] and "Müller" not in got[3]["text"] and got[3]["n_entities"] == 2 and got[4]["text"] is None


@pytest.mark.parametrize("value", ["2001:db8:85a3::8a2e:370:7334", "fe80::1", "::1", "2001:0DB8:0:0:0:0:0:1", "::ffff:192.0.2.7", "555 123 4567", "089 1234567", "030/12345678", "(089) 123 45 67", "0171-1234567", "020 7946 0958"])
def test_addresses_and_phones_of_other_forms(spark, value):
    rows = [(1, f"see {value}, or {value}. End"), (2, "from 01/02/2003 12:30:45 to 01-02-2003, std::vector a::b 00:1a:2b:3c:4d:5e")]
    got = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), "key").collect()}
    one, two = re.fullmatch(r"see (.+), or (.+)\. End", got[1]["text"]).groups()
    assert one == two != value and got[1]["n_entities"] == 2
    if "::" not in value and value.count(":") != 7:
        assert re.sub(r"\d", "0", one) == re.sub(r"\d", "0", value)
    assert got[2]["text"] == rows[1][1]


def test_assigned_secrets_in_any_case(spark):
    rows = [(i, x) for i, x in enumerate(["API_KEY=Zx81kkQ9pLm2", "AWS_SECRET_ACCESS_KEY=Zx81kkQ9pLm2", "Password: Zx81kkQ9pLm2", "TOKEN = Zx81kkQ9pLm2", '{"apiKey": "Zx81kkQ9pLm2"}'])]
    for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), "key").collect():
        assert "Zx81kkQ9pLm2" not in r["text"] and r["n_entities"] == 1


def test_formats_are_kept(spark):
    """Check digits hold if they did, private addresses stay private and public ones public."""
    import ipaddress

    def mod_97(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "DE99370400440532013000", "FR1420041010050500013M02606"]
    addresses = ["10.1.2.3", "192.168.0.7", "172.16.5.4", "172.31.9.9", "127.0.0.1", "169.254.1.1", "8.8.8.8", "172.32.0.1", "193.99.144.80"]
    rows = [(i, f"pay {v} or ask {v}") for i, v in enumerate(ibans + addresses)]
    got = {r["doc_id"]: r["text"].split() for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id int, text string"), "key").collect()}
    for i, v in enumerate(ibans + addresses):
        new = got[i][1]
        assert new == got[i][4] != v
        if i < len(ibans):
            assert new[:2] == v[:2] and len(new) == len(v) and (mod_97(new) == 1) == (mod_97(v) == 1) and [c.isdigit() for c in new] == [c.isdigit() for c in v]
        else:
            assert ipaddress.ip_address(new).is_private == ipaddress.ip_address(v).is_private and ipaddress.ip_address(new).is_loopback == ipaddress.ip_address(v).is_loopback


def test_lists_grow_and_blocks_of_any_size_agree(spark, monkeypatch):
    """Chains of near vectors that fill a list, clashing columns, repeated rows, ids at both ends; small blocks of both kinds."""
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(16) for _ in range(60)]
    base = rng.standard_normal(16)
    x += [base + rng.standard_normal(16) * s for s in np.linspace(0.1, 0.45, 120)]
    x += [x[0], x[0] * 3]
    ids = [*range(len(x) - 2), -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i, v.tolist(), 1, "vec", 2.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rep int, vec string, comp double")
    u = np.stack(x) / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    for name, value in (("BLOCK", 8), ("MANY", 20), ("WIDE", 16), ("NEIGHBOURS", 3), ("BUCKET", 6)):
        monkeypatch.setattr(nn_descent, name, value)
    got = {r["vec_id"]: r for r in nn_descent.near_vectors(rows).collect()}
    assert [got[i]["n_links"] for i in ids] == true.tolist() and true.max() > 10
    assert got[0]["component_id"] == got[(1 << 63) - 1]["component_id"] == -(1 << 63)


def test_votes_by_brute_force():
    """Similarity-weighted labels of the nearest voters, ties at the last place included, whatever the voters' order."""
    from gridloom.llm import quality_knn

    rng = np.random.default_rng(9)
    voters = quality_knn.unit(rng.standard_normal((60, 8)).astype(np.float32))
    voters[40:] = voters[20:40]  # ties
    labels, vectors = rng.integers(0, 2, 60).astype(float), quality_knn.unit(rng.standard_normal((700, 8)).astype(np.float32))
    vectors[5] = 0
    want = []
    for v in vectors.astype(float):
        cosine = [sum(a * b for a, b in zip(v, q)) for q in voters.astype(float).tolist()]
        last = sorted(cosine, reverse=True)[4]
        w = [max(c, 0) ** 4 if c >= last - 1e-6 else 0.0 for c in cosine]
        want.append(sum(x * y for x, y in zip(w, labels)) / sum(w) if sum(w) > 0 else labels.mean())
    turn = rng.permutation(60)
    assert np.allclose(quality_knn.vote(vectors, voters, labels, 5), want, atol=1e-4)
    assert np.allclose(quality_knn.vote(vectors, voters[turn], labels[turn], 5), want, atol=1e-4)


@pytest.mark.parametrize("sizes", [[1000, 10, 500, 3], [5, 5, 5], [7], [0, 100, 0], [], [1, 10**6, 1], [10**6, 1, 1, 1, 1]])
def test_targets_by_brute_force(sizes):
    """The level at which shares by weight, none above twice the size, sum up to 150 %."""
    from gridloom.llm import mixing

    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    at = lambda level: [min(level * w, 2 * s) for w, s in zip(weights, sizes)]
    low, high = 0.0, 2.0 * sum(sizes) + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) < 1.5 * sum(sizes) else (low, middle)
    assert np.allclose(mixing.targets(sizes), at(high), rtol=1e-9, atol=1e-6)


def test_small_cache_of_the_encoder_gives_equal_ids(spark):
    """The pipeline's encoder keeps a cache of its own, smaller size, and encodes as with the usual one."""
    import corpus_pipeline as p

    content = open(queries.vocabulary_path(), encoding="utf-8").read()
    batches = [[" ".join(f"wo{i * 400 + k:x}rd's same" for k in range(400))] * 2 for i in range(30)]
    usual, small = bpe.WordBPE(content), bpe.WordBPE(content, cache=200_000)
    held = []
    for texts in batches:
        assert small.encode_batch(texts) == usual.encode_batch(texts)
        held.append(small.held)
    assert usual.held > 2_000_000 and max(held) < 600_000 and len(small.new) + len(small.old) < len(usual.new) / 3
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(batches)] + [(None, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["token_ids"] for r in bpe.encode_documents(rows, queries.vocabulary_path(), cache=1, batch_bytes=5000).collect()}
    assert got == {i: usual.encode_batch(t)[0][0] for i, t in enumerate(batches)} | {None: []}
    assert 2 * p.ENCODER_CACHE <= bpe.CACHE and p.ENCODER_BATCH < bpe.BATCH_BYTES


def test_a_worker_drops_what_other_operators_keep():
    import weakref

    class Kept:
        pass

    gone = weakref.ref(common.worker_cache("one", 1, Kept))
    assert list(common.tidy(iter, "one")([1, 2])) == [1, 2] and gone() is not None
    assert list(common.tidy(iter)([1, 2])) == [1, 2] and gone() is None


def test_sources_of_the_mix_start_no_workers_of_another_kind(spark, monkeypatch):
    from pyspark import SparkContext

    rows = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", None), (3, None, "ß")], "doc_id long, text string, source string").localCheckpoint()
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("a table from rows of Python"))
    got = {r["doc_id"]: (r["source_no"], r["size"], r["source_size"]) for r in mixing.taken_words(rows).collect()}
    assert got == {1: (0, 3, 3), 2: (2, 2, 2), 3: (1, 0, 0)}
