"""Samples for evaluation sets: deterministic by hash, not by a generator's state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of the md5 of seed and key; each row's chance is the same."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def top_keywords(rows: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, rank, word, times): the most frequent keywords of each text, ties by first appearance."""
    words = rows.select(key, F.posexplode(tx.tokens(F.col(text), tx.EVALUATION_STOPWORDS, 4)).alias("pos", "word"))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("times"), "pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", "word", "times")


def keyword_query(words: Column, breadcrumb: Column) -> Column:
    """A question from keywords, with the place in the outline where there is one."""
    two = F.array_join(F.slice(words, 1, 2), " e ")
    placed = F.concat(F.lit("O que o material diz sobre "), two, F.lit(" em: "), breadcrumb, F.lit("?"))
    related = F.concat(F.lit("Explique a relação entre "), F.get(words, F.lit(0)), F.lit(" e "), F.get(words, F.lit(1)), F.lit("."))
    return F.when(F.size(words) == 0, "").when(F.coalesce(breadcrumb, F.lit("")) != "", placed).when(F.size(words) >= 2, related).otherwise(F.concat(F.lit("O que é "), F.get(words, F.lit(0)), F.lit("?")))


def with_query_sentence(rows: DataFrame, text: str, name: str = "sentence") -> DataFrame:
    """The rows with the most telling sentence of their text, null without one of 40 characters (30 when cleaned).

    Signs of a definition count three, each step from the middle sentence takes one off; of
    equal sentences the first.
    """
    kept = F.filter(F.transform(F.split(tx.strip(F.col(text)), r"(?<=[.!?])[\s\p{Z}]+"), tx.strip), lambda s: F.length(s) >= 40)
    base = rows.withColumn("__s", kept).withColumn("__m", F.floor(F.size("__s") / 2).cast("int"))
    marked = lambda s: reduce(lambda acc, m: acc | F.contains(F.lower(s), F.lit(m)), tx.DEFINITION_MARKERS, F.lit(False))
    scored = F.transform("__s", lambda s, i: F.struct((F.when(marked(s), 3).otherwise(0) - F.abs(i - F.col("__m"))).alias("score"), (-i).alias("back"), s.alias("s")))
    best = base.withColumn("__b", tx.strip(F.regexp_replace(F.array_max(scored)["s"], r"\[.*?\]|\(p\.\s*\d+\)", "")))
    return best.withColumn(name, F.when(F.length("__b") >= 30, F.col("__b"))).drop("__s", "__m", "__b")


def synthetic_items(chunks: DataFrame, n: int, seed: int = 42, key: str = "chunk_id") -> DataFrame:
    """(key, query): sampled chunks with a query from their own text."""
    drawn = hash_sample(chunks.where(F.col("text").rlike(r"[^\s\p{Z}]")), key, n, seed)
    words = top_keywords(drawn, key, "text").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("kw"))
    joined = with_query_sentence(drawn.join(words, key, "left"), "text", "__q")
    fallback = keyword_query(F.coalesce("kw", F.array().cast("array<string>")), F.col("breadcrumb"))
    return joined.select(key, F.coalesce("__q", fallback).alias("query")).where("query <> ''")


def chunk_groups(chunks: DataFrame, size: int, n: int, seed: int = 42, span: int = 6, key: str = "chunk_id") -> DataFrame:
    """(group_no, position, key): groups of neighbouring chunks of one unit and chapter.

    Chunks of 200 characters or more are ordered by page, those without one last; the i-th group
    of an outline key takes the next ``size`` of them, and is dropped if its pages lie more than
    ``span`` apart. Groups are taken in turns from the keys, the keys in hashed order. Runs are
    cut at page gaps over the span first, so groups do not straddle them.
    """
    if size <= 0 or n <= 0:
        return chunks.sparkSession.createDataFrame([], f"group_no int, position int, {key} {chunks.schema[key].dataType.simpleString()}")
    # only the places are lined up, not the texts
    long = chunks.where(F.length("text") >= 200).select(key, "unit", "chapter", "page")
    by_key = Window.partitionBy("unit", "chapter")
    ordered = by_key.orderBy(F.col("page").asc_nulls_last(), key)
    gap = F.coalesce(F.col("page") - F.lag("page").over(ordered) > span, F.lit(False))
    runs = long.withColumn("__gap", gap).withColumn("__run", F.sum(F.col("__gap").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("unit", "chapter", "__run").orderBy(F.col("page").asc_nulls_last(), key)) - 1
    cut = runs.withColumn("__i", place).withColumn("__g", F.floor(F.col("__i") / size))
    group = Window.partitionBy("unit", "chapter", "__run", "__g")
    fit = cut.withColumns({"__n": F.count("*").over(group), "__wide": F.coalesce(F.max("page").over(group) - F.min("page").over(group), F.lit(0))}).where((F.col("__n") == size) & ((F.col("__wide") <= span) | F.lit(size == 1)))
    heads = fit.where(F.col("__i") % size == 0)
    turn = heads.withColumn("__turn", F.row_number().over(by_key.orderBy("__run", "__g")))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", F.coalesce("unit", F.lit("")), F.coalesce("chapter", F.lit("")))))
    # a top-n, so each task keeps n rows
    taken = turn.orderBy("__turn", hashed, "unit", "chapter").limit(n)
    numbered = taken.withColumn("group_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__turn", hashed, "unit", "chapter"))).select(
        "group_no", F.col("unit").alias("u"), F.col("chapter").alias("c"), F.col("__run").alias("r"), F.col("__g").alias("g")
    )
    same = fit["unit"].eqNullSafe(numbered["u"]) & fit["chapter"].eqNullSafe(numbered["c"]) & (fit["__run"] == numbered["r"]) & (fit["__g"] == numbered["g"])
    return fit.join(numbered, same).select("group_no", (F.col("__i") % size + 1).cast("int").alias("position"), key)


def entry_ids(items: DataFrame, order: list[str]) -> DataFrame:
    """Items of an evaluation set with sequential ids q0001, q0002, ...; sets are small by nature."""
    return items.withColumn("id", F.format_string("q%04d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))))


def category_of(size: Column) -> Column:
    return F.when(size <= 1, "factual").otherwise("multi_hop")
