"""Ranking metrics, guardrails and failure analysis.

``results`` are rows (qid, cid, rank), ``qrels`` rows (qid, cid, relevance); a relevance of 0
or less is no relevance. Repeated qrels count once, with their highest relevance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def relevant(qrels: DataFrame) -> DataFrame:
    """Distinct (qid, cid, relevance) with a positive relevance, 3 where it is null."""
    graded = qrels.select("qid", "cid", F.coalesce(F.col("relevance"), F.lit(3)).cast("double").alias("relevance"))
    return graded.where("relevance > 0 AND qid IS NOT NULL AND cid IS NOT NULL AND cast(cid AS string) <> ''").groupBy("qid", "cid").agg(F.max("relevance").alias("relevance"))


def per_query(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int, graded: bool = True) -> DataFrame:
    """Metrics at k of every query: n_results, n_relevant, precision, recall, f1, hit, rr, ndcg, ap.

    Precision divides by the rows returned, not by k. A row returned twice counts once for
    recall. A query without results or without relevant rows has 0 throughout.
    """
    wanted = relevant(qrels)
    gain = F.col("relevance") if graded else F.lit(1.0)
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "cid"))
    ideal = wanted.withColumn("i", ideal_rank).groupBy("qid").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1))).alias("idcg"))
    top = results.where(F.col("rank") <= k).select("qid", "cid", "rank").join(wanted, ["qid", "cid"], "left")
    top = top.withColumn("rel", F.col("relevance").isNotNull().cast("int"))
    # a relevant row repeated in the results is relevant at its first rank
    top = top.withColumn("rel", F.when(F.row_number().over(Window.partitionBy("qid", "cid").orderBy("rank")) == 1, F.col("rel")).otherwise(0))
    so_far = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("hits", so_far)
    found = top.groupBy("qid").agg(
        F.count("*").alias("n_results"),
        F.sum("rel").alias("n_hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, (F.col("relevance") if graded else F.lit(1.0)) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank"))).alias("gained"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = queries.select("qid").distinct().join(found, "qid", "left").join(ideal, "qid", "left")
    precision, recall = zero(F.col("n_hits") / F.col("n_results")), zero(F.col("n_hits") / F.col("n_relevant"))
    return joined.select(
        "qid",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        (F.coalesce("n_hits", F.lit(0)) > 0).cast("int").alias("hit"),
        zero(1 / F.col("first")).alias("rr"),
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(F.col("gained") / F.least(F.col("n_relevant"), F.lit(k))).alias("ap"),
    )


_MEANS = ("precision", "recall", "f1", "hit", "rr", "ndcg", "ap")


def report(metrics: DataFrame) -> DataFrame:
    """Means over all queries."""
    return metrics.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in _MEANS])


def report_by_category(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, n, hit, recall, rr); queries of no category are "uncategorized"."""
    named = metrics.join(categories.select("qid", "category"), "qid", "left")
    label = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    return named.groupBy(label.alias("category")).agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("rr").alias("rr"))


def guardrail(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, retrieved, passed) of queries that must find nothing."""
    counts = results.groupBy("qid").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("qid").distinct().join(counts, "qid", "left").select("qid", n.alias("retrieved"), (n == 0).alias("passed"))


def guardrail_rate(checked: DataFrame) -> DataFrame:
    """(n, passed, rate) of what ``guardrail`` gives; the rate of no queries is 1."""
    return checked.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(1.0)).alias("rate"))


def failure_stages(queries: DataFrame, trace: DataFrame, qrels: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(qid, hit, first_rank, failure_stage): where a query lost its relevant rows.

    ``stages`` are the names of the trace's stages in order. The stage is the first one without
    relevant rows after one that had them, the first of all where none ever had them, null for
    a hit and for queries without relevant rows.
    """
    wanted = relevant(qrels)
    last = len(stages) - 1
    seen = trace.join(wanted.select("qid", "cid"), ["qid", "cid"], "left_semi").groupBy("qid", "stage_no").agg(F.min("rank").alias("rank"))
    asked = queries.select("qid").distinct().join(wanted.select("qid").distinct().withColumn("has", F.lit(True)), "qid", "left")
    spans = seen.groupBy("qid").agg(F.sort_array(F.collect_set("stage_no")).alias("at"), F.min(F.when(F.col("stage_no") == 0, F.col("rank"))).alias("first_rank"))
    gone = F.get(F.filter(F.sequence(F.element_at("at", 1), F.lit(last)), lambda s: ~F.array_contains("at", s)), F.lit(0))
    hit = F.coalesce(F.array_contains("at", F.lit(last)), F.lit(False))
    number = F.when(F.col("has").isNull() | hit, None).when(F.col("at").isNull(), 0).otherwise(gone)
    names = F.array(*[F.lit(s) for s in stages])
    return asked.join(spans, "qid", "left").select("qid", hit.alias("hit"), "first_rank", F.get(names, number).alias("failure_stage"))


#: Values of the order that one task of ``neighbour_qrels`` lines up.
STRETCH = 65_536


def neighbour_qrels(rows: DataFrame, row_id: str, source: str, order: str) -> DataFrame:
    """(qid, cid, relevance): each row is relevant to itself and to its neighbours in the source.

    ``order`` is a number. A source is lined up in stretches of it; the ends of neighbouring
    stretches are joined to the rows at their edges, so a source of any size is many tasks.
    """
    slim = rows.select(F.col(row_id).alias("qid"), F.col(source).alias("s"), F.col(order).alias("o")).withColumn("stretch", F.floor(F.col("o") / STRETCH))
    w = Window.partitionBy("s", "stretch").orderBy("o", "qid")
    ends = slim.groupBy("s", "stretch").agg(F.min(F.struct("o", "qid")).alias("first"), F.max(F.struct("o", "qid")).alias("last"))
    along = Window.partitionBy("s").orderBy("stretch")
    ends = ends.select(F.col("s").alias("__s"), F.col("stretch").alias("__stretch"), F.lag("last.qid").over(along).alias("from"), F.lead("first.qid").over(along).alias("to"))
    near = slim.withColumns({"before": F.lag("qid").over(w), "behind": F.lead("qid").over(w)})
    joined = near.join(ends, near["s"].eqNullSafe(ends["__s"]) & near["stretch"].eqNullSafe(ends["__stretch"]))
    around = F.array("qid", F.coalesce("before", "from"), F.coalesce("behind", "to"))
    return joined.select("qid", F.explode(around).alias("cid"), F.lit(3).alias("relevance")).where("cid IS NOT NULL")


def compare(reports: DataFrame, name: str, metrics: list[str], best_of: int = 2) -> DataFrame:
    """(metric, name, value, best): named reports in long form with the best of each metric marked."""
    long = reports.select(name, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    flat = long.select("x.metric", name, "x.value")
    return flat.withColumn("best", F.col("value") == F.max("value").over(Window.partitionBy("metric")))
