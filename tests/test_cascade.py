"""The cascade on worked values."""

import pytest
from pyspark.sql import functions as F

from quillon.config import RetrievalConfig
from quillon.operators import cascade


def candidates(spark, scores, texts=None, query=None):
    rows = [(1, i, float(s), i + 1, (texts[i].split() if texts else ["a"]), query) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "qid int, cid int, score double, rank int, ctok array<string>, qtok array<string>")


def kept(df):
    return [round(r.score, 6) for r in df.orderBy("rank").collect()]


TEN = [0.70, 0.68, 0.66, 0.64, 0.62, 0.60, 0.58, 0.56, 0.54, 0.52]


@pytest.mark.parametrize(("sigma", "n"), [(1, 3), (2, 6), (3, 9)])
def test_adaptive(spark, sigma, n):
    assert len(kept(cascade.adaptive_filter(candidates(spark, TEN), 0.25, sigma))) == n


def test_adaptive_with_equal_scores_keeps_all(spark):
    assert len(kept(cascade.adaptive_filter(candidates(spark, [0.5] * 5), 0.25, 1))) == 5


@pytest.mark.parametrize(("scores", "left"), [([0.34, 0.33, 0.32, 0.31, 0.30], []), ([0.95, 0.40, 0.38], [0.95]), ([0.30], [0.30]), ([0.5, 0.35, 0.3], [0.5, 0.35])])
def test_gap(spark, scores, left):
    assert kept(cascade.gap_filter(candidates(spark, scores), 0.65, 0.45)) == left


def test_absolute(spark):
    assert kept(cascade.absolute_filter(candidates(spark, [0.2, 0.15]), 0.25)) == []


def test_keyword(spark):
    texts = ["python is fun", "bake a cake"]
    assert kept(cascade.keyword_filter(candidates(spark, [0.9, 0.8], texts, ["python"]))) == [0.9]
    assert kept(cascade.keyword_filter(candidates(spark, [0.9, 0.8], texts, []))) == [0.9, 0.8]
    assert kept(cascade.keyword_filter(candidates(spark, [0.9, 0.8], texts, None))) == [0.9, 0.8]


BM_TEXTS = ["revolução x y z w", "x y z w v", "revolução liberdade x y z"]


def test_bm25_and_hybrid(spark):
    base = candidates(spark, [0.9, 0.8, 0.3], BM_TEXTS, ["revolução", "liberdade"])
    # document frequencies 2 and 1 of 3 rows of five tokens each
    import math

    idf = {2: math.log(1.5 / 2.5 + 1), 1: math.log(2.5 / 1.5 + 1)}
    got = {r.cid: r.bm25 for r in cascade.bm25(base).collect()}
    assert got == pytest.approx({0: idf[2], 1: 0.0, 2: idf[2] + idf[1]}, abs=1e-6)
    mixed = cascade.hybrid_rerank(base, 1.0).orderBy("rank").collect()
    assert [r.cid for r in mixed] == [2, 0, 1]
    assert [r.cid for r in cascade.hybrid_rerank(base, 0.0).orderBy("rank").collect()] == [0, 1, 2]


def test_repeated_query_tokens_count_again(spark):
    once = cascade.bm25(candidates(spark, [0.9, 0.8, 0.3], BM_TEXTS, ["liberdade"])).where("cid = 2").first().bm25
    twice = cascade.bm25(candidates(spark, [0.9, 0.8, 0.3], BM_TEXTS, ["liberdade", "liberdade"])).where("cid = 2").first().bm25
    assert twice == pytest.approx(2 * once)


def test_rows_without_tokens_score_zero(spark):
    empty = spark.createDataFrame([(1, 0, 0.5, 1, [], ["a"]), (1, 1, 0.4, 2, None, ["a"])], "qid int, cid int, score double, rank int, ctok array<string>, qtok array<string>")
    assert [r.bm25 for r in cascade.bm25(empty).collect()] == [0.0, 0.0]


def test_two_candidates_keep_their_scores(spark):
    assert kept(cascade.hybrid_rerank(candidates(spark, [0.6, 0.6], ["a", "a"], ["a"]), 0.4)) == [0.6, 0.6]


RAW = {0: 0.9, 1: 0.1, 2: 0.5, 3: 0.7, 4: 0.3}


@pytest.mark.parametrize(
    ("weight", "floor", "order", "first"),
    [(0.4, 0.0, [0, 3, 2, 1, 4], 1.0), (0.0, 0.0, [0, 3, 2, 4, 1], 1.0), (1.0, 0.0, [0, 1, 2, 3, 4], 1.0), (0.4, 0.4, [0, 3, 2], 1.0), (0.4, 5.0, [], None)],
)
def test_pair_rerank(spark, weight, floor, order, first):
    raw = F.element_at(F.create_map(*[F.lit(x) for kv in RAW.items() for x in kv]), F.col("cid"))
    config = RetrievalConfig(pair_scorer=True, pair_hybrid_weight=weight, pair_min_score=floor)
    rows = cascade.pair_rerank(candidates(spark, [0.8, 0.7, 0.6, 0.5, 0.4]), raw, config).orderBy("rank").collect()
    assert [r.cid for r in rows] == order
    assert not rows or rows[0].score == pytest.approx(first)


def test_a_lone_survivor_scores_zero(spark):
    config = RetrievalConfig(pair_scorer=True, pair_min_score=0.8)
    raw = F.when(F.col("cid") == 0, 0.9).otherwise(0.1)
    assert kept(cascade.pair_rerank(candidates(spark, [0.8, 0.7]), raw, config)) == [0.0]


def test_stage_counts_do_not_grow(spark):
    base = candidates(spark, TEN, ["a b"] * 10, ["a"])
    counts = [df.count() for df in cascade.stages(base, RetrievalConfig()).values()]
    assert counts == sorted(counts, reverse=True)


def test_best_confidence(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    results = spark.createDataFrame([(1, 0.7), (1, 0.1), (2, 0.2)], "qid int, score double")
    assert {r.qid: r.confidence for r in cascade.best_confidence(results, queries, RetrievalConfig()).collect()} == {1: "high", 2: "low", 3: "none"}


def test_pool_size():
    assert [RetrievalConfig(top_k=5, candidate_multiplier=m).pool for m in (4, 6, 8, 10)] == [20, 30, 40, 50]
    assert RetrievalConfig(top_k=5, pair_scorer=True).pool == 80
    assert RetrievalConfig().with_(min_score=None, top_k=0).top_k == 0
