"""Reference passages linked to stored chunks by their beginnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

PREFIX = 120
#: Passages, of less than 120 characters each, that are sent to all executors (some 30 MB).
FEW = 100_000
#: Lengths of the pieces by which shorter passages are looked up; a passage goes by the longest that fits in it.
WIDTHS = (32, 16, 8, 4, 2, 1)


def _pieces(head: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(head) - width + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(head, i, F.lit(width))))


def link_passages(passages: DataFrame, chunks: DataFrame, passage_id: str = "item_id", passage: str = "passage", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(item, chunk): pairs where the passage's first 120 characters lie in the chunk's first 120.

    A beginning of full length can only be equal, which is an equi-join. A shorter passage is
    joined by its first characters to the pieces of that length of each chunk's beginning, and
    looked for there. Blank passages and null ids or texts give no rows; repeated rows count once.
    """
    cut = lambda c: F.substring(tx.strip(F.col(c)), 1, PREFIX)
    asked = passages.where(F.col(passage_id).isNotNull()).select(F.col(passage_id).alias("item"), cut(passage).alias("p")).where("p <> ''").distinct()
    heads = chunks.where(F.col(chunk_id).isNotNull()).select(F.col(chunk_id).alias("chunk"), cut(text).alias("h")).where("h <> ''").distinct()
    out = asked.where(F.length("p") == PREFIX).join(heads, F.col("p") == F.col("h")).select("item", "chunk")
    width = F.coalesce(*[F.when(F.length("p") >= w, w) for w in WIDTHS])
    short = asked.where(F.length("p") < PREFIX).withColumn("w", width)
    sizes = {r.w: r.n for r in short.groupBy("w").agg(F.count("*").alias("n")).collect()}
    for w, n in sizes.items():
        keyed = short.where(F.col("w") == w).withColumn("piece", F.substring("p", 1, w)).drop("w")
        pieces = heads.where(F.length("h") >= w).select("chunk", "h", F.explode(_pieces(F.col("h"), w)).alias("piece"))
        # a head becomes many rows, which the planner cannot know: the passages are sent if they are few, else both sides are shuffled
        met = pieces.join(F.broadcast(keyed) if n <= FEW else keyed.hint("merge"), "piece")
        out = out.unionByName(met.where(F.contains("h", F.col("p"))).select("item", "chunk"))
    return out.distinct()
