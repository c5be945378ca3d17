"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Only DataFrame functions touch rows.  Each text is read once into a row of
counts; the rules turn these into votes (1 good, -1 bad, 0 abstain); the
distinct vote patterns - at most 3 ** len(RULES), whatever the corpus - are
counted and expectation-maximisation on them estimates what share of documents
is good or has a kind of defect, and how often each rule is right.  A document is kept if its posterior
probability of being good reaches ``keep_at`` and no base rule fails.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The array of words of a text, empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight words that the array holds twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def twins(order: Column) -> Column:
        return _let(F.array_sort(F.transform(F.filter(order, lambda p, j: _beside(order, p, j)), lambda p: p["i"])), covered)

    def counted(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(order, twins)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, _let(windows, counted)).otherwise(F.lit(0).cast("long"))


def _beside(order: Column, p: Column, j: Column) -> Column:
    """Whether a neighbour in the sorted array has the same hash; at the ends one neighbour is missing."""
    same = lambda k: F.coalesce(F.get(order, k)["h"] == p["h"], F.lit(False))
    return same(j - 1) | same(j + 1)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document."""
    text = F.col(text_col)
    counts = _let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        F.col(id_col).alias("doc_id"),
        counts.alias("c"),
        F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}{2}")), F.lit(0)).cast("long").alias("n_shouted"),
        F.coalesce(F.regexp_count(text, F.lit("[!?]{2}|[.]{4}")), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.regexp_count(text, F.lit("[0-9]+")), F.lit(0)).cast("long").alias("n_numbers"),
        (F.coalesce(F.regexp_count(text, F.lit(r"\n")), F.lit(0)) + 1).cast("long").alias("n_lines"),
    ).select("doc_id", "c.*", "n_symbols", "n_dup_lines", "n_shouted", "n_runs", "n_numbers", "n_lines")


def _ratio(part: str, whole: str = "n_words"):
    """A share of two counts, made when it is asked for."""
    return lambda: F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: (name, the measure, good at or below, bad above): between the two it abstains.
RULES = [
    ("symbols", _ratio("n_symbols"), 0.02, 0.2),
    ("shouting", _ratio("n_shouted"), 0.05, 0.4),
    ("runs", _ratio("n_runs"), 0.01, 0.2),
    ("repeats", _ratio("n_repeat_words"), 0.1, 0.3),
    ("lines", _ratio("n_dup_lines", "n_lines"), 0.1, 0.4),
    ("numbers", _ratio("n_numbers"), 0.1, 0.4),
    ("length", lambda: F.abs(_ratio("word_chars")() - 6.0), 2.5, 6.0),
]


def votes(measured: DataFrame) -> DataFrame:
    """Adds the array ``votes``; a document without words gets only abstentions."""
    vote = lambda x, good, bad: F.when(F.col("n_words") == 0, 0).when(x <= good, 1).when(x > bad, -1).otherwise(0)
    return measured.withColumn("votes", F.array(*(vote(x(), good, bad) for _, x, good, bad in RULES)))


#: What is believed before votes are seen: a kind of defect is in this share of documents, and a rule votes bad on this share of good ones.
DEFECT, ERROR = 0.02, 0.002
#: How many documents, for each document there is, these two beliefs count as.
DEFECT_WEIGHT, ERROR_WEIGHT = 0.15, 0.07


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: (shares of kinds of documents, how often each rule votes bad on each kind).

    Kind 0 is good; kind r + 1 has the defect that rule r looks for, as most bad
    documents have one defect and other rules say nothing about it.  Votes are
    independent within a kind; abstentions tell nothing.  Votes alone cannot say
    whether a rule that fires alone finds a defect or errs, so the beliefs above
    weigh in: a rule that fires alone on a few percent is taken to be right, one
    that does on a fifth of all documents to be noise, and agreement with other
    rules counts for both.  Without any pattern the start stands.
    """
    n = len(patterns[0][0]) if patterns else len(RULES)
    believed = np.array([1 - DEFECT * n, *[DEFECT] * n])
    start = np.full((n + 1, n), 0.01)
    start[np.arange(1, n + 1), np.arange(n)] = 0.9
    share, bad = believed, start
    if not patterns:
        return share, bad
    votes, count = np.array([v for v, _ in patterns]), np.array([float(c) for _, c in patterns])
    total = count.sum()
    for _ in range(rounds):
        weight = kinds(votes, share, bad) * count[:, None]
        new = (weight.sum(axis=0) + DEFECT_WEIGHT * total * believed) / (total * (1 + DEFECT_WEIGHT))
        fired, spoke = weight.T @ (votes < 0), weight.T @ (votes != 0)
        rate = (fired + start) / (spoke + 1)
        rate[0] = (fired[0] + ERROR_WEIGHT * total * ERROR) / (spoke[0] + ERROR_WEIGHT * total)
        rate[1:] = np.maximum(rate[1:], rate[0])  # a defect makes no rule fire less often, so a further bad vote never speaks for a document
        moved = np.abs(new - share).max() + np.abs(rate - bad).max()
        share, bad = new, rate
        if moved < 1e-7:
            break
    return share, bad


def kinds(votes: np.ndarray, share: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The probability of each kind for each row of votes."""
    odds = np.log(share) + (votes < 0) @ np.log(bad).T + (votes > 0) @ np.log1p(-bad).T
    odds = np.exp(odds - odds.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def posterior(vote: tuple[int, ...], share: np.ndarray, bad: np.ndarray) -> float:
    """The probability that a document with these votes is good: of kind 0, or of a kind whose own rule fires no more often than on good ones."""
    own = bad[np.arange(1, len(share)), np.arange(len(share) - 1)]
    good = np.append(True, own <= 1.001 * bad[0])
    return float(kinds(np.array([vote]), share, bad)[0, good].sum())


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict of every document.

    Null and empty texts have no words: their counts are 0, every rule abstains
    and the base rule on length fails.  Repeated rows give repeated results;
    null ids are carried through.  An empty table gives an empty result.
    """
    measured = checkpoint(votes(features(docs, id_col, text_col)))
    patterns = [(tuple(r["votes"]), r["n"]) for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    share, bad = fit(sorted(patterns))
    table = docs.sparkSession.createDataFrame([([*v], posterior(v, share, bad)) for v, _ in patterns], "votes array<int>, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = measured.join(F.broadcast(table), "votes")  # a row for each pattern, at most 3 ** len(RULES)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep_at))
