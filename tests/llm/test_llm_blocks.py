"""Parts of vectors stay bounded when many rows repeat an id; ids and codes."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from txscreen.llm import ann


@pytest.mark.parametrize("query_part", [32_768, 2])
def test_copies_of_an_id_spread_over_parts(spark, monkeypatch, query_part):
    monkeypatch.setattr(ann, "PART_BYTES", 50 * 8 * 4)
    monkeypatch.setattr(ann, "LEAST_PARTS", 1)
    monkeypatch.setattr(ann, "QUERY_PART", query_part)
    monkeypatch.setattr(ann, "BLOCK", 16)
    made, deal = {}, ann._dealt

    def spy(rows, own, *rest):
        made[own] = deal(rows, own, *rest)
        return made[own]

    monkeypatch.setattr(ann, "_dealt", spy)
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((900, 8)).astype(np.float32)
    vectors[150:300] = vectors[150]
    ids = [7 if i < 300 else 1000 + i for i in range(900)]
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = ann.nearest(table, query_every=100, top=5).collect()
    parts = made["part"].groupBy("part", "number").count()
    assert parts.agg(F.max("count")).first()[0] <= 100

    answers = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        answers[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = vectors.astype(np.float64)
    asked = [k for k, i in enumerate(ids) if i % 100 == 0]
    assert set(answers) == {ids[k] for k in asked}
    for k in asked:
        scores = (wide * wide[k]).sum(axis=1)
        best = sorted((-s, i) for s, i in zip(scores, ids) if i != ids[k])[:5]
        assert [i for i, _ in answers[ids[k]]] == [i for _, i in best]
        assert np.allclose([s for _, s in answers[ids[k]]], [-s for s, _ in best])


def test_ids_must_be_integers(spark):
    table = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>")
    with pytest.raises(ValueError, match="integer"):
        ann.nearest(table)


def test_bounds_spare_most_exact_scores(monkeypatch):
    """All vectors alike but for their length, exactly coded ones, and ties at the last place."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((20_000, 64)).astype(np.float32)
    vectors[1000:1100] = vectors[1000]
    ids = rng.permutation(len(vectors)).astype(np.int64)
    turn, centre = ann.rotation(64, ann.WIDE), vectors.mean(axis=0, dtype=np.float64)
    assert turn.shape == (128, 64) and np.allclose(turn.T @ turn, np.eye(64))
    scored, exact = [], ann.exact

    def counted(query, some):
        scored.append(len(some))
        return exact(query, some)

    monkeypatch.setattr(ann, "exact", counted)
    part = ann._Part(centre, turn, 20)
    for start in range(0, len(ids), 3000):
        part.add(ids[start : start + 3000], vectors[start : start + 3000])
    asked = np.concatenate([np.arange(0, 20_000, 500), [1000]])
    queries, names, scores = part.search(ids[asked], vectors[asked])
    assert sum(scored) < 0.35 * len(asked) * len(ids)
    hits = 0
    for q in asked.tolist():
        right = exact(vectors[q], vectors)
        order = [i for i in np.lexsort((ids, -right)) if ids[i] != ids[q]][:20]
        mine = queries == ids[q]
        hits += len(set(names[mine][:20].tolist()) & set(ids[order].tolist()))
        if q == 1000:  # 99 copies of the query tie: the smallest ids win
            assert names[mine][:20].tolist() == ids[order].tolist()
    assert hits >= 0.97 * 20 * len(asked)
    same = ann._Part(vectors[0].astype(np.float64), turn, 3)
    same.add(np.arange(50), np.repeat(vectors[:1], 50, axis=0))
    assert same.search(np.array([1]), vectors[:1])[1].tolist() == [0, 2, 3]
