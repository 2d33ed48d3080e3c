"""Ranked search against scores of every document by the formula."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_cases import CLASHES, PASSAGE, TYPES, awkward_rows

from txscreen.llm import retrieval

ASKED = [
    (0, "quick brown FOX, quick again"),
    (1, PASSAGE),
    (2, None),
    (3, "?!"),
    (4, "nowhere at all"),
    (5, "shared line seen everywhere own line 3"),
    (5, "köln"),
    (None, "7 12 z" + "z" * 4999),
]


def terms(text):
    return re.findall(retrieval.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, query):
    """Scores of all texts, in Python's own whole numbers."""
    counts = [Counter(terms(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    docs, tokens = sum(n > 0 for n in sizes), sum(sizes)
    scores = [0] * len(texts)
    for term in terms(query):
        df = sum(term in c for c in counts)
        weight = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
        for i, c in enumerate(counts):
            if term in c:
                m = 100 - 25 + (25 * sizes[i] * docs) // tokens
                scores[i] += weight * ((1_000_000_000 * c[term]) // (1000 * c[term] + 12 * m))
    return scores


def best(ids, scores, top):
    ranked = sorted((-s, i is None, i or 0) for i, s in zip(ids, scores) if s > 0)
    return [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(ranked[:top])]


@pytest.mark.parametrize(("top", "piece_bytes"), [(20, retrieval.PIECE_BYTES), (3, 3000)])
def test_ranks_equal_the_formula(spark, top, piece_bytes):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, TYPES).repartition(3)
    docs = docs.withColumns({c: F.lit("own") for c in [*CLASHES, "item_id", "query", "n", "terms"]})
    asked = spark.createDataFrame(ASKED, "item_id long, text string")
    asked = asked.withColumns({c: F.lit("own") for c in ("query", "terms", "rank")})
    found = retrieval.search(docs, asked, top=top, piece_bytes=piece_bytes)
    wanted = []
    for item, query in ASKED:
        scores = plain([r[1] for r in rows], query)
        wanted += [(item, *r) for r in best([r[0] for r in rows], scores, top)]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, wanted))


def test_blocks_find_what_a_full_scan_finds():
    """Many ties, hot and rare terms, weights of nothing, and a bound from earlier blocks."""
    draw = random.Random(5)
    for docs, vocabulary in ((1, 1), (3, 2), (40, 6), (700, 30)):
        lists = [sorted(draw.sample(range(vocabulary), draw.randint(0, vocabulary))) for _ in range(docs)]
        counts = [[draw.choice([1, 1, 2, 9]) for _ in own] for own in lists]
        sizes = np.array([sum(c) + draw.choice([0, 0, 50]) for c in counts])
        flat = np.array([t for own in lists for t in own], np.int64)
        statistics = retrieval.Statistics(
            docs, max(1, int(sizes.sum())), np.bincount(flat, minlength=vocabulary)
        )
        weights = statistics.weights()
        weights[0] = 0
        lengths = np.array([len(own) for own in lists])
        tf = np.array([n for c in counts for n in c], np.int64)
        block = retrieval.Block(sizes, lengths, flat, tf, statistics, weights)
        for _ in range(20):
            query = np.array(sorted(draw.sample(range(vocabulary), draw.randint(1, vocabulary))))
            times = np.array([draw.choice([1, 2]) for _ in query])
            scores = []
            for i, own in enumerate(lists):
                m = 75 + 25 * int(sizes[i]) * docs // statistics.tokens
                part = {t: 10**9 * n // (1000 * n + 12 * m) for t, n in zip(own, counts[i])}
                scores.append(sum(int(w) * int(weights[t]) * part.get(t, 0) for t, w in zip(query, times)))
            for top, floor in ((1, 1), (5, 1), (5, sorted(scores)[docs // 2])):
                found = dict(zip(*(a.tolist() for a in block.search(query, times, top, floor))))
                least = max(1, floor, sorted(scores)[-top] if top <= docs else 1)
                assert found == {i: s for i, s in enumerate(scores) if s >= least}


def test_few_intervals_are_opened(spark):
    """Far fewer documents are scored than the block has, for rare terms and frequent ones."""
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in items for t in terms(x)}))}
    counts = [Counter(vocabulary[t] for t in terms(x) if t in vocabulary) for x in texts]
    sizes = np.array([len(terms(x)) for x in texts])
    flat = np.array([t for c in counts for t in c], np.int64)
    statistics = retrieval.Statistics(
        len(texts), int(sizes.sum()), np.bincount(flat, minlength=len(vocabulary))
    )
    tf = np.array([n for c in counts for n in c.values()], np.int64)
    lengths = np.array([len(c) for c in counts])
    block = retrieval.Block(sizes, lengths, flat, tf, statistics, statistics.weights())
    opened, bounds = 0, block._bounds

    def counted(low, high, times):
        nonlocal opened
        opened += len(low)
        return bounds(low, high, times)

    block._bounds = counted
    for x in items:
        c = Counter(vocabulary[t] for t in terms(x))
        block.search(np.array(list(c)), np.array(list(c.values())), 5, 1)
    assert opened / 2 < 0.4 * len(items) * len(texts)


def test_string_ids_and_empty_tables(spark):
    rows = [("b", "one two"), ("a", "one two"), (None, "two one"), ("c", "three")]
    docs = spark.createDataFrame(rows, "name string, body string")
    asked = spark.createDataFrame([("q", "one")], "no string, question string")
    names = {"doc_id": "name", "text": "body", "item_id": "no", "item_text": "question"}
    found = retrieval.search(docs, asked, top=5, **names).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in found] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
    assert retrieval.search(docs.limit(0), asked, **names).collect() == []
    assert retrieval.search(docs, asked.limit(0), **names).collect() == []
