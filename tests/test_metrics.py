"""Ranking metrics on worked values, and against a plain implementation."""

import math
import random

import pytest

from quillon.operators import metrics


def scored(spark, retrieved, relevant, k, graded=True):
    queries = spark.createDataFrame([(1,)], "qid int")
    results = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(retrieved)], "qid int, cid string, rank int")
    qrels = spark.createDataFrame([(1, c, g) for c, g in relevant.items()], "qid int, cid string, relevance int")
    return metrics.per_query(queries, results, qrels, k, graded).first()


def test_worked_values(spark):
    assert scored(spark, ["a", "b"], {"a": 1}, 2).precision == 0.5
    assert scored(spark, ["a", "b", "c", "d"], {"c": 1, "d": 1}, 2).precision == 0
    assert scored(spark, ["a", "x"], {"a": 1, "b": 1}, 5).recall == 0.5
    assert scored(spark, ["x", "y", "a"], {"a": 1}, 5).rr == pytest.approx(1 / 3)
    assert scored(spark, ["a", "b"], {"a": 3, "b": 1}, 2).ndcg == pytest.approx(1.0)
    assert scored(spark, ["b", "a"], {"a": 3, "b": 1}, 2).ndcg == pytest.approx(0.796708, abs=1e-6)
    assert scored(spark, ["a"], {"a": 1, "z": 0}, 5).n_relevant == 1
    assert scored(spark, [], {"a": 1}, 5).hit == 0
    assert scored(spark, ["a", "a"], {"a": 1}, 5).recall == 1.0


def test_against_plain_code(spark):
    r = random.Random(3)
    for _ in range(6):
        names = [f"c{i}" for i in range(12)]
        retrieved = r.sample(names, r.randint(1, 10))
        relevant = {c: r.randint(1, 3) for c in r.sample(names, r.randint(1, 6))}
        k = r.randint(1, 8)
        top = retrieved[:k]
        hits = [c in relevant for c in top]
        dcg = sum(relevant.get(c, 0) / math.log2(i + 2) for i, c in enumerate(top))
        idcg = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(relevant.values(), reverse=True)[:k]))
        ap = sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / min(len(relevant), k)
        got = scored(spark, retrieved, relevant, k)
        assert (got.precision, got.recall, got.ndcg, got.ap) == pytest.approx((sum(hits) / len(top), sum(hits) / len(relevant), dcg / idcg, ap))


def test_failure_stage(spark):
    queries = spark.createDataFrame([(q,) for q in range(1, 6)], "qid int")
    qrels = spark.createDataFrame([(1, 10, 3), (2, 10, 3), (3, 10, 3), (4, 99, 3)], "qid int, cid int, relevance int")
    stages = ["semantic", "absolute", "final"]
    seen = {1: [0, 1, 2], 2: [0, 1], 3: [0], 4: []}
    rows = [(s, stages[s], q, 10 if s in at else 11, 1) for q, at in seen.items() for s in range(3)]
    trace = spark.createDataFrame(rows, "stage_no int, stage string, qid int, cid int, rank int")
    got = {r.qid: (r.hit, r.failure_stage) for r in metrics.failure_stages(queries, trace, qrels, tuple(stages)).collect()}
    assert got == {1: (True, None), 2: (False, "final"), 3: (False, "absolute"), 4: (False, "semantic"), 5: (False, None)}


def test_guardrail(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid int")
    results = spark.createDataFrame([(1, "a")], "qid int, cid string")
    assert {r.qid: r.passed for r in metrics.guardrail(queries, results).collect()} == {1: False, 2: True}
