"""Evaluation sets generated from stored chunks: groups of one, two and three, questions by a model, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators import dialogue, sampling
from quillon.providers import GenerationProvider, generate


def question_prompts(chunks: DataFrame, groups: DataFrame, system: str, key: str = "chunk_id") -> DataFrame:
    """(group_no, chunk_ids, breadcrumb, messages) of groups (group_no, position, key)."""
    rows = groups.join(chunks.select(key, "text", "breadcrumb"), key)
    # a group has a few chunks, as many as it was drawn with
    gathered = rows.groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("position", F.col(key).alias("id"), "text", "breadcrumb"))).alias("xs"))
    return gathered.select(
        "group_no", F.transform("xs", lambda x: x["id"]).alias("chunk_ids"), F.coalesce(F.get("xs", F.lit(0))["breadcrumb"], F.lit("")).alias("breadcrumb"),
        dialogue.question_messages(F.transform("xs", lambda x: x["text"]), system).alias("messages"),
    )


def flat_prompt(messages: Column) -> Column:
    """Messages as one text, for providers that take no list."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


def generated_items(chunks: DataFrame, provider: GenerationProvider, negatives: list[str], singles: int = 100, pairs: int = 30, triples: int = 20, seed: int = 42, system: str = "", key: str = "chunk_id") -> DataFrame:
    """(id, query, relevant_chunks, category, answerable, n_source_chunks, source_breadcrumb).

    Each family is drawn by a seed of its own. Questions that are none after cleaning are left
    out; the others are numbered through in the order of family and group, the negatives behind.
    """
    parts = []
    for size, n in ((1, singles), (2, pairs), (3, triples)):
        groups = sampling.chunk_groups(chunks, size, n, seed + size, key=key)
        asked = question_prompts(chunks, groups, system, key)
        parts.append(asked.select(F.lit(size).alias("family"), "group_no", "chunk_ids", "breadcrumb", tx.clean_question(generate(provider, flat_prompt(F.col("messages")))).alias("query")))
    good = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("query IS NOT NULL")
    linked = F.transform("chunk_ids", lambda c: F.struct(c.cast("string").alias("chunk_id"), F.lit(3).alias("relevance")))
    made = good.select(
        "family", "group_no", "query", linked.alias("relevant_chunks"), sampling.category_of(F.col("family")).alias("category"), F.lit(True).alias("answerable"),
        F.col("family").alias("n_source_chunks"), F.col("breadcrumb").alias("source_breadcrumb"),
    )
    spark = chunks.sparkSession
    shape = "family int, group_no int, query string, relevant_chunks array<struct<chunk_id:string,relevance:int>>, category string, answerable boolean, n_source_chunks int, source_breadcrumb string"
    none = spark.createDataFrame([(9, i, q, [], "negative", False, None, "") for i, q in enumerate(negatives)], shape)
    # some hundred items at most, brought together by the constant window on purpose
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("family", "group_no")) - 1
    every = made.unionByName(none).withColumn("id", F.format_string("q%04d", place))
    return every.select("id", "query", "relevant_chunks", "category", "answerable", "n_source_chunks", "source_breadcrumb")
