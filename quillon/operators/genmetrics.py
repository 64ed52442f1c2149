"""Quality of generated answers, without a model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.providers import EmbeddingProvider, embed


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word's worth of positions at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for y in b:
        met = open_ & places.get(y, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


# a type object, as the workers that import this module have no session to parse a string with
_ROUGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])


@F.pandas_udf(_ROUGE)
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Precision, recall and F1 of the longest common subsequence of words; nulls count as empty."""
    rows = []
    for a, r in zip(answer, reference):
        own, ref = (a or "").lower().split(), (r or "").lower().split()
        n = common_length(own, ref)
        p, c = (n / len(own), n / len(ref)) if n else (0.0, 0.0)
        rows.append((p, c, 2 * p * c / (p + c) if n else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def tfidf_similarity(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, similarity): cosine of both texts' TF-IDF vectors over their own two documents.

    Weights are tf / length times ln(3 / (df + 1)) + 1; 0 where a text has no words or is null.
    """
    both = pairs.select(F.col(key), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("t")), F.struct(F.lit(1).alias("side"), F.col(b).alias("t")))).alias("x"))
    words = both.select(key, "x.side", F.explode(tx.tokens(F.coalesce("x.t", F.lit("")))).alias("w"))
    side = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).cast("double")
    counts = words.groupBy(key, "w").agg(side(0).alias("na"), side(1).alias("nb"))
    lengths = Window.partitionBy(key)
    idf = F.log(3 / ((F.col("na") > 0).cast("int") + (F.col("nb") > 0).cast("int") + 1)) + 1
    weights = counts.withColumns({"ta": F.sum("na").over(lengths), "tb": F.sum("nb").over(lengths)}).select(
        key, (F.when(F.col("ta") > 0, F.col("na") / F.col("ta")).otherwise(0.0) * idf).alias("wa"), (F.when(F.col("tb") > 0, F.col("nb") / F.col("tb")).otherwise(0.0) * idf).alias("wb")
    )
    sums = weights.groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("d"), F.sum(F.col("wa") * F.col("wa")).alias("aa"), F.sum(F.col("wb") * F.col("wb")).alias("bb"))
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("d") / (F.sqrt("aa") * F.sqrt("bb"))).otherwise(0.0)
    return pairs.select(key).distinct().join(sums, key, "left").select(key, F.coalesce(cosine, F.lit(0.0)).alias("similarity"))


def similarity(pairs: DataFrame, key: str, a: str, b: str, provider: EmbeddingProvider | None = None) -> DataFrame:
    """(key, similarity): cosine of both texts' vectors by a model, by TF-IDF without one.

    The same serves for an answer and its reference, an answer and its question, a context and
    its question. Null texts count as empty.
    """
    if provider is None:
        return tfidf_similarity(pairs, key, a, b)
    sides = pairs.select(F.col(key), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.coalesce(a, F.lit("")).alias("t")), F.struct(F.lit(1).alias("side"), F.coalesce(b, F.lit("")).alias("t")))).alias("x")).select(key, "x.side", "x.t")
    vectors = embed(sides, provider, "t")
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("embedding")))
    both = vectors.groupBy(key).agg(of(0).alias("va"), of(1).alias("vb"))
    return both.select(key, cosine(F.col("va"), F.col("vb")).alias("similarity"))


def with_faithfulness(rows: DataFrame, answer: str, context: str, threshold: float = 0.08, name: str = "faithfulness") -> DataFrame:
    """The rows with the share of the answer's sentences that the context supports.

    A sentence is supported if its long words overlap the context's enough, or enough of them
    stand there; sentences without long words are not. 0 without sentences. The words of the
    context are a column of their own, so that they are taken once a row.
    """
    base = rows.withColumns({"__parts": tx.plain_sentences(F.coalesce(answer, F.lit("")), 10), "__around": tx.long_words(F.coalesce(context, F.lit("")))})
    base = base.withColumn("__own", F.transform("__parts", lambda s: tx.long_words(s)))

    def supported(own: Column) -> Column:
        covered = F.size(F.array_intersect(own, F.col("__around"))) / F.size(own)
        return (F.size(own) > 0) & ((tx.jaccard(own, F.col("__around")) >= threshold) | (covered >= 0.35))

    share = F.when(F.size("__parts") == 0, 0.0).otherwise(F.size(F.filter("__own", supported)) / F.size("__parts"))
    return base.withColumn(name, share).drop("__parts", "__around", "__own")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def answer_report(scored: DataFrame, *by: str) -> DataFrame:
    """Means of answer metrics by group; nulls do not count.

    ``scored`` has answerable, refused and any of faithfulness, relevance, rouge, exact. Quality
    is averaged over answerable items; ``refusal_precision`` and ``refusal_recall`` say how well
    refusals fall on the unanswerable ones.
    """
    yes = F.coalesce("answerable", F.lit(True))
    of_answerable = [F.avg(F.when(yes, F.col(m).cast("double"))).alias(m) for m in ("faithfulness", "relevance", "rouge", "exact") if m in scored.columns]
    both = F.sum((~yes & F.col("refused")).cast("int"))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), *of_answerable, F.try_divide(both, F.sum(F.col("refused").cast("int"))).alias("refusal_precision"), F.try_divide(both, F.sum((~yes).cast("int"))).alias("refusal_recall")
    )


def relative_change(reports: DataFrame, order: str, metric: str) -> DataFrame:
    """Each report with the change of a metric against the first one by ``order``."""
    # a handful of reports, brought together by the constant window on purpose
    first = F.first(metric).over(Window.partitionBy(F.lit(0)).orderBy(order))
    return reports.withColumn("change", F.when(first != 0, (F.col(metric) - first) / first))
