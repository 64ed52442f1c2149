"""Reports over chunks, sources and timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx


def first_of_text(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of every distinct text, by the hash of the text; null texts are left out.

    Hashing first keeps the texts themselves out of the sort.
    """
    w = Window.partitionBy("text_md5").orderBy(*order)
    hashed = rows.where(F.col(text).isNotNull()).withColumn("text_md5", tx.text_hash(F.col(text)))
    return hashed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_texts(rows: DataFrame, stored: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of every text that a stored table (text_md5) does not hold yet."""
    return first_of_text(rows, text, order).join(stored.select("text_md5").distinct(), "text_md5", "left_anti")


def chunk_stats(chunks: DataFrame, text: str = "text", tiny: int = 30, huge: int = 600) -> DataFrame:
    """One row: count, sum, mean, least and largest token counts, and how many are tiny or huge."""
    t = tx.count_tokens(F.col(text))
    return chunks.select(t.alias("t")).agg(
        F.count("*").alias("n"), F.sum("t").alias("tokens"), F.avg("t").alias("mean_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"),
        F.count_if(F.col("t") < tiny).alias("n_tiny"), F.count_if(F.col("t") > huge).alias("n_huge"),
    )


def structure_report(chunks: DataFrame) -> DataFrame:
    """(unit, chapter, chunks, topics): chunks and distinct topics of each heading."""
    return chunks.groupBy("unit", "chapter").agg(F.count("*").alias("chunks"), F.count_distinct("topic").alias("topics"))


def unstructured_share(chunks: DataFrame) -> DataFrame:
    """One row: the share of chunks without unit and chapter."""
    none = (F.col("unit").isNull() & F.col("chapter").isNull()).cast("int")
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.avg(none), F.lit(0.0)).alias("unstructured"))


def source_report(chunks: DataFrame) -> DataFrame:
    """(source, rows, pages, units, chapters, topics): distinct values of each source."""
    counted = [F.count_distinct(c).alias(f"{c}s") for c in ("page", "unit", "chapter", "topic")]
    return chunks.groupBy("source").agg(F.count("*").alias("rows"), *counted)


def body_sizes(spans: DataFrame) -> DataFrame:
    """(source, body_size): the most frequent size of lines not in bold, to one decimal, 12 without any.

    ``spans`` (source, pos, bold, size); ties go to the size met first.
    """
    votes = spans.where(~F.coalesce("bold", F.lit(False)) & F.col("size").isNotNull()).groupBy("source", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    best = votes.groupBy("source").agg(F.max_by("s", F.struct("n", -F.col("p"))).alias("body_size"))
    return spans.select("source").distinct().join(best, "source", "left").select("source", F.coalesce("body_size", F.lit(12.0)).alias("body_size"))


def styled_lines(spans: DataFrame) -> DataFrame:
    """(source, page, line_no, text, bold, size) from the spans of each line.

    ``spans`` (source, page, line_no, span_no, text, flags, font, size): a span is bold by its
    flag bit 4 or its font's name, a line if all its spans are; its size is the largest.
    """
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.contains(F.lower(F.replace("font", F.lit(" "), F.lit(""))), F.lit("bold"))
    parts = F.array_sort(F.collect_list(F.struct("span_no", "text")))
    return spans.groupBy("source", "page", "line_no").agg(
        tx.strip(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("text"), F.bool_and(F.coalesce(bold, F.lit(False))).alias("bold"), F.max("size").alias("size")
    )


#: Parts of equal weight into which the values of a group are cut to find their places.
PARTS = 100


def latencies(rows: DataFrame, value: str, *by: str, percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Count, mean, least, largest value and the percentiles of each group.

    A percentile p is the value at place int(n * p / 100) from 0 in ascending order, the last at
    most. Equal values are counted first. A group is cut into ``PARTS`` by a mergeable sketch of
    its quantiles; the parts' counts tell which of them holds a place, and the values of those
    parts alone are ordered. So a group of any size is many tasks and no list of values is built.
    """
    keys = list(by)
    kept = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    counts = kept.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    cuts = [i / PARTS for i in range(1, PARTS)]
    edges = kept.groupBy(*keys).agg(F.percentile_approx("v", cuts, 10 * PARTS).alias("edges"))
    named = edges.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [counts[k].eqNullSafe(named[f"__{k}"]) for k in keys] or [F.lit(True)]
    placed = counts.join(named, reduce(Column.__and__, same)).withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("v")))).select(*keys, "v", "c", "part")
    parts = placed.groupBy(*keys, "part").agg(F.sum("c").alias("held"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    ahead = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"ahead": ahead, "n": F.sum("held").over(group)})
    place = lambda p: F.least((F.col("n") * p / 100).cast("bigint"), F.col("n") - 1)
    wanted = reduce(Column.__or__, [(place(p) >= F.col("ahead")) & (place(p) < F.col("ahead") + F.col("held")) for p in percentiles])
    hit = parts.where(wanted).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), "ahead", "n")
    same = [placed[k].eqNullSafe(hit[f"__{k}"]) for k in keys] + [placed["part"] == hit["__part"]]
    within = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(hit, reduce(Column.__and__, same)).withColumn("upto", F.col("ahead") + F.sum("c").over(within))
    at = lambda p: F.max(F.when((F.col("upto") > place(p)) & (F.col("upto") - F.col("c") <= place(p)), F.col("v"))).alias(f"p{p}")
    places = found.groupBy(*keys).agg(*[at(p) for p in percentiles]).withColumnsRenamed({k: f"__{k}" for k in keys})
    whole = parts.groupBy(*keys).agg(F.sum("held").alias("n"), (F.sum("total") / F.sum("held")).alias("mean"), F.min("low").alias("least"), F.max("high").alias("largest"))
    same = [whole[k].eqNullSafe(places[f"__{k}"]) for k in keys] or [F.lit(True)]
    return whole.join(places, reduce(Column.__and__, same)).drop(*[f"__{k}" for k in keys])


def pivot(rows: DataFrame, index: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """A table with one column for each of the given values."""
    return rows.groupBy(index).pivot(column, values).agg(measure)


def growth(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, first, last, growth) of a series."""
    ends = samples.groupBy(by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return ends.withColumn("growth", F.col("last") - F.col("first"))
