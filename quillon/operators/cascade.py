"""The retrieval cascade over a table of candidates.

Candidates are rows (qid, cid, score, rank, ...), ranked from 1 within each query; every stage
takes and returns such a table and handles all queries at once with windows over qid. A query
without candidates has no rows. Ties keep the rank they had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import RetrievalConfig
from quillon.functions import text as tx
from quillon.runtime import materialize


def _by_query():
    return Window.partitionBy("qid")


#: Fixed values of the ranking function.
BM25_K1, BM25_B = 1.5, 0.75
#: Fixed values of the gap filter: what is kept below a high and a low best score, and the least gap.
GAP_HIGH, GAP_LOW, GAP_LEAST = 0.20, 0.18, 0.10


def absolute_filter(candidates: DataFrame, min_score: float) -> DataFrame:
    return candidates.where(F.col("score") >= min_score)


def adaptive_filter(candidates: DataFrame, min_score: float, sigma: float) -> DataFrame:
    """Scores no further below the best than sigma deviations of the query's candidates."""
    limit = F.greatest(F.lit(min_score), F.max("score").over(_by_query()) - sigma * F.stddev_pop("score").over(_by_query()))
    return candidates.withColumn("__limit", limit).where("score >= __limit").drop("__limit")


def gap_filter(candidates: DataFrame, high: float, low: float) -> DataFrame:
    """Scores near the best; where the best is weak it must stand out from the mean of the others."""
    best = F.max("score").over(_by_query())
    marked = candidates.withColumn("__best", best)
    others = F.coalesce(F.avg(F.when(F.col("score") != F.col("__best"), F.col("score"))).over(_by_query()), F.lit(0.0))
    marked = marked.withColumn("__others", others)
    keep = (
        F.when(F.col("__best") >= high, F.col("score") >= F.col("__best") - GAP_HIGH)
        .when(F.col("__best") >= low, F.col("score") >= F.col("__best") - GAP_LOW)
        .otherwise((F.col("__best") - F.col("__others") >= GAP_LEAST) & (F.col("score") >= F.col("__best") - GAP_LOW))
    )
    return marked.where(keep).drop("__best", "__others")


def keyword_filter(candidates: DataFrame, query_tokens: str = "qtok", row_tokens: str = "ctok") -> DataFrame:
    """Rows that share a token with their query; queries without tokens let all pass."""
    q = F.coalesce(F.col(query_tokens), F.array().cast("array<string>"))
    return candidates.where((F.size(q) == 0) | F.coalesce(F.arrays_overlap(q, F.col(row_tokens)), F.lit(False)))


def min_max(value: Column) -> Column:
    """Values scaled to 0..1 within a query; all 0 where they are equal."""
    low, high = F.min(value).over(_by_query()), F.max(value).over(_by_query())
    return F.when(high - low < 1e-9, 0.0).otherwise((value - low) / (high - low))


def bm25(candidates: DataFrame, query_tokens: str = "qtok", row_tokens: str = "ctok") -> DataFrame:
    """The candidates with ``bm25``, statistics taken over each query's own candidates.

    A query token counts as often as it stands in the query. Pools are small, so the token
    frequencies are taken inside the row by array functions, and only one row a query and
    distinct token is aggregated.
    """
    empty = F.array().cast("array<string>")
    q, c = F.coalesce(F.col(query_tokens), empty), F.coalesce(F.col(row_tokens), empty)
    base = candidates.withColumns({"__q": q, "__c": c})
    base = base.withColumns({"__dl": F.size("__c"), "__n": F.count("*").over(_by_query())}).withColumn("__avg", F.avg("__dl").over(_by_query()))
    exploded = base.select("qid", "cid", "__c", "__dl", "__n", "__avg", F.explode("__q").alias("tok"))
    counted = exploded.groupBy("qid", "cid", "tok").agg(
        F.count("*").alias("times"), F.first(F.expr("size(filter(__c, x -> x = tok))")).alias("tf"), F.first("__dl").alias("dl"), F.first("__n").alias("n"), F.first("__avg").alias("avgdl")
    )
    df = F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).over(Window.partitionBy("qid", "tok"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    spread = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    part = F.when((F.col("tf") > 0) & (F.col("avgdl") > 0), F.col("times") * idf * F.col("tf") * (BM25_K1 + 1) / (spread + 1e-9)).otherwise(0.0)
    scores = counted.withColumn("df", df).withColumn("part", part).groupBy("qid", "cid").agg(F.sum("part").alias("bm25"))
    kept = [x for x in base.columns if not x.startswith("__")]
    return base.select(*kept).join(scores, ["qid", "cid"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """The candidates with a new score, ranked by it; ties keep their order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "__was")
    return candidates.withColumn("__was", F.col("rank")).withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("__was")


def hybrid_rerank(candidates: DataFrame, lexical_weight: float, query_tokens: str = "qtok", row_tokens: str = "ctok") -> DataFrame:
    """Similarity and BM25, each scaled within the query, mixed by the lexical weight.

    Fewer than three candidates, a weight of 0 or a query without tokens keep their scores.
    """
    if lexical_weight == 0:
        return rerank(candidates, F.col("score")).withColumn("bm25", F.lit(0.0))
    scored = bm25(candidates, query_tokens, row_tokens)
    mixed = (1 - lexical_weight) * min_max(F.col("score")) + lexical_weight * min_max(F.col("bm25"))
    plain = (F.count("*").over(_by_query()) < 3) | (F.size(F.coalesce(F.col(query_tokens), F.array().cast("array<string>"))) == 0)
    return rerank(scored.withColumn("__new", F.when(plain, F.col("score")).otherwise(mixed)), F.col("__new")).drop("__new")


def pair_rerank(candidates: DataFrame, pair_score: Column, config: RetrievalConfig) -> DataFrame:
    """The best candidates rescored in pairs with their query, floored, scaled and fused.

    Only the first ``pair_top_k`` reach the scorer. Raw scores under the floor drop out before
    the scaling, so a lone survivor gets 0. Adds ``hybrid_score`` and ``pair_score``.
    """
    head = candidates.where(F.col("rank") <= config.pair_top_k).withColumn("pair_score", pair_score)
    kept = head.where(F.col("pair_score") >= config.pair_min_score).withColumn("hybrid_score", F.col("score"))
    fused = config.pair_hybrid_weight * min_max(F.col("hybrid_score")) + (1 - config.pair_hybrid_weight) * min_max(F.col("pair_score"))
    return rerank(kept.withColumn("__new", fused), F.col("__new")).drop("__new").where(F.col("rank") <= config.top_k)


#: Names of the stages in their order.
STAGES = ("semantic", "absolute", "adaptive", "gap", "keyword", "hybrid", "final")


def stages(candidates: DataFrame, config: RetrievalConfig, pair_score: Column | None = None) -> dict[str, DataFrame]:
    """The candidates after every stage that the configuration switches on, by name."""
    out = {"semantic": candidates.where(F.col("rank") <= config.pool)}
    out["absolute"] = absolute_filter(out["semantic"], config.min_score)
    last = out["adaptive"] = adaptive_filter(out["absolute"], config.min_score, config.adaptive_sigma)
    if config.gap_filter:
        last = out["gap"] = gap_filter(last, config.high_confidence, config.low_confidence)
    if config.keyword_filter:
        last = out["keyword"] = keyword_filter(last)
    last = out["hybrid"] = hybrid_rerank(last, config.lexical_weight)
    if config.pair_scorer:
        if pair_score is None:
            raise ValueError("the configuration asks for a pair scorer")
        last = pair_rerank(last, pair_score, config)
    final = last.where(F.col("rank") <= config.top_k)
    out["final"] = final.withColumn("confidence", tx.confidence(F.col("score"), config.high_confidence, config.low_confidence))
    return out


def retrieve(candidates: DataFrame, config: RetrievalConfig, pair_score: Column | None = None) -> DataFrame:
    return stages(candidates, config, pair_score)["final"]


def trace(candidates: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(stage_no, stage, qid, cid, rank, score) of every stage; the candidates are computed once."""
    out, candidates = None, materialize(candidates, "candidates")
    for number, (name, df) in enumerate(stages(candidates, config).items()):
        part = df.select(F.lit(number).alias("stage_no"), F.lit(name).alias("stage"), "qid", "cid", "rank", "score")
        out = part if out is None else out.unionByName(part)
    return out


def best_confidence(results: DataFrame, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(qid, confidence) by the best score of each query, "none" without results."""
    best = results.groupBy("qid").agg(F.max("score").alias("best"))
    label = F.when(F.col("best").isNull(), "none").otherwise(tx.confidence(F.col("best"), config.high_confidence, config.low_confidence))
    return queries.select("qid").distinct().join(best, "qid", "left").select("qid", label.alias("confidence"))


def confidence_notice(best: Column) -> Column:
    """The notice before an answer: low, medium or empty."""
    return F.when(best.isNull(), "").when(best < 0.45, "low").when(best < 0.65, "medium").otherwise("")
