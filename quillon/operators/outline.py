"""Outline of a source: lines, heading levels, sections.

A heading of level 1 resets levels 2 and 3, one of level 2 resets level 3. The state runs over
all pages of a source; it is computed from running counts taken in two steps, over stretches of
pages and within each, so that a source of any length is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.runtime import materialize

#: Rows of a source (pages or documents) that one task orders.
STRETCH = 512
LEVELS = (1, 2, 3)


def lines(pages: DataFrame, key: str = "page_key") -> DataFrame:
    """(source, page, key, line_no, line, level, title): the lines of all pages but tables of contents.

    A page with more than five non-blank lines, over four tenths of which have dotted leaders,
    is a table of contents. ``bold_lines`` and ``body_size`` are used where the table has them.
    """
    solid = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "")
    dotted = F.size(F.filter(solid, lambda x: F.contains(x, F.lit(".....")) | F.contains(x, F.lit("…"))))
    contents = (F.size(solid) > 5) & (dotted > F.size(solid) * 0.4)
    styled = "bold_lines" in pages.columns
    kept = pages.where(F.col("text").isNotNull() & ~contents)
    extra = ["bold_lines", "body_size", "bold_nfc"] if styled else []
    if styled:
        kept = kept.withColumn("bold_nfc", tx.compose_all(F.transform("bold_lines", lambda b: b["text"])))
    split = kept.select("source", "page", F.col(key).alias("key"), *extra, F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))
    if styled:
        # both sides are compared in canonical form; of repeated lines the last size counts
        norm = F.regexp_replace(tx.strip(F.col("line_nfc")), r"\s+", " ")
        styles = F.arrays_zip(F.col("bold_nfc").alias("text"), F.transform("bold_lines", lambda b: b["size"]).alias("size"))
        same = F.filter(styles, lambda b: F.regexp_replace(tx.strip(b["text"]), r"\s+", " ") == norm)
        split = split.withColumn("line_nfc", tx.compose(F.col("line"))).withColumn("size", F.get(same, F.size(same) - 1)["size"])
        level = tx.line_level(F.col("line"), F.col("size"), F.col("body_size"))
    else:
        level = tx.line_level(F.col("line"))
    return split.select("source", "page", "key", "line_no", "line", level.alias("level"), tx.clean_heading(F.col("line")).alias("title"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], nullable: list[str], how: str = "inner") -> DataFrame:
    """Joined on the keys, and on the nullable columns as well, null meeting null; the right side's are dropped."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in [*keys, *nullable]})
    on = [left[c] == named[f"__{c}"] for c in keys] + [left[c].eqNullSafe(named[f"__{c}"]) for c in nullable]
    return left.join(named, on, how).drop(*[f"__{c}" for c in [*keys, *nullable]])


def sections(pages: DataFrame, key: str = "page_key") -> DataFrame:
    """(source, document, section, page, unit, chapter, topic, level, breadcrumb, text) of every source.

    A section starts at each heading, its first line is the cleaned title; blank sections are
    dropped. Pages go in the order of page, then ``key``; its page is that of its first line.
    Null sources are one source; null texts have no lines.
    """
    # levels are costly to find and several steps ask for them, so the lines are written once
    all_lines = materialize(lines(pages, key), "lines").withColumn("document", F.when(F.col("page").isNull(), F.col("key")))
    order = ["page", "key", "line_no"]
    # pages are counted off in stretches, so a source of any length is many tasks; its key stands for null parts too
    marked = all_lines.withColumns({"stretch": (F.coalesce(F.col("page"), F.lit(0)) / STRETCH).cast("int"), "sk": F.xxhash64("source", F.col("document").cast("string"))})
    head = F.col("level") > 0
    within = Window.partitionBy("sk", "source", "document", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("n", F.sum(head.cast("int")).over(within))
    # what a stretch hands on: how many headings it has and the last of each level; one row a stretch
    last_in = [F.max_by(F.when(head, F.struct("n", "title")), F.when(F.col("level") == n, F.col("n"))).alias(f"h{n}") for n in LEVELS]
    totals = counted.groupBy("sk", "source", "document", "stretch").agg(F.sum(head.cast("int")).alias("heads"), *last_in)
    before = Window.partitionBy("sk", "source", "document").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("heads").over(before), F.lit(0)))
    placed = [F.when(F.col(f"h{n}").isNotNull(), F.struct((F.col(f"h{n}.n") + F.col("base")).alias("section"), F.col(f"h{n}.title").alias("head"))).alias(f"h{n}") for n in LEVELS]
    carried = totals.select("*", *[c.alias(f"p{n}") for n, c in zip(LEVELS, placed)]).select(
        "sk", "source", "document", "stretch", "base", *[F.last(f"p{n}", ignorenulls=True).over(before).alias(f"c{n}") for n in LEVELS]
    )
    numbered = _join(counted, carried, ["sk", "stretch"], ["source", "document"]).withColumn("section", F.col("n") + F.col("base"))
    body = F.when(head, F.col("title")).otherwise(F.col("line"))
    grouped = numbered.groupBy("sk", "source", "document", "section").agg(
        F.min(F.struct(F.coalesce("page", F.lit(-1)).alias("o"), "page")).alias("p"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(-1)).alias("o"), "key", "line_no", body.alias("t")))).alias("parts"),
    )
    # the outline's state goes along headings alone, one row each and without text
    state = Window.partitionBy("sk", "source", "document", "stretch").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    heads = numbered.where(head).select("sk", "source", "document", "stretch", "section", "level", "title", *[f"c{n}" for n in LEVELS])
    last = lambda n: F.coalesce(F.last(F.when(F.col("level") == n, F.struct("section", F.col("title").alias("head"))), ignorenulls=True).over(state), F.col(f"c{n}"))
    states = heads.select("sk", "source", "document", "section", last(1).alias("u"), last(2).alias("c"), last(3).alias("t3"))
    full = _join(grouped, states, ["sk", "section"], ["source", "document"], "left")
    unit_at, chapter_at = F.coalesce("u.section", F.lit(-1)), F.coalesce("c.section", F.lit(-1))
    chapter = F.when(F.col("c.section") > unit_at, F.nullif("c.head", F.lit("")))
    topic = F.when((F.col("t3.section") > unit_at) & (F.col("t3.section") > chapter_at), F.nullif("t3.head", F.lit("")))
    out = full.select(
        "source", "document", F.col("section").cast("int").alias("section"), F.col("p.page").alias("page"), F.nullif("u.head", F.lit("")).alias("unit"), chapter.alias("chapter"), topic.alias("topic"),
        tx.strip(F.array_join(F.transform("parts", lambda x: x["t"]), "\n")).alias("text"),
    )
    level = F.when(F.col("topic").isNotNull(), 3).when(F.col("chapter").isNotNull(), 2).when(F.col("unit").isNotNull(), 1).otherwise(0)
    return out.where(F.col("text") != "").withColumns({"level": level, "breadcrumb": tx.breadcrumb(F.col("unit"), F.col("chapter"), F.col("topic"))})


def section_documents(sections_: DataFrame) -> DataFrame:
    """Sections as documents: ``section`` is the most specific heading."""
    return sections_.withColumnRenamed("section", "section_no").withColumn("section", F.coalesce("topic", "chapter", "unit"))


def merge_tiny(sections_: DataFrame, min_tokens: int) -> DataFrame:
    """Sections below ``min_tokens`` take in the ones behind them in the same source.

    A merged section keeps the headings of its first. The fold stops at every section that is
    large enough, so runs are cut there first and only runs of small sections are folded.
    """
    fields = ["page", "unit", "chapter", "topic", "level", "breadcrumb"]
    marked = sections_.withColumn("sk", F.xxhash64("source", F.col("document").cast("string")))
    # the fold needs the sizes alone: words of joined texts add up
    sizes = marked.select("sk", "source", "document", "section", F.size(tx.words_of(F.col("text"))).alias("words"))
    small = tx.tokens_of(F.col("words")) < min_tokens
    w = Window.partitionBy("sk", "source", "document").orderBy("section")
    # a section may join the one before only if that one alone is small or is itself a merged one
    start = F.coalesce(~F.lag("__small").over(w), F.lit(True))
    runs = sizes.withColumn("__small", small).withColumn("__start", start).withColumn("__run", F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy("sk", "source", "document", "__run").agg(F.array_sort(F.collect_list(F.struct("section", "words"))).alias("xs"))
    kind = sections_.schema["section"].dataType.simpleString()
    begin = F.struct(F.array().cast(f"array<struct<section:{kind},first:{kind}>>").alias("out"), F.lit(None).cast(kind).alias("first"), F.lit(0).alias("words"))

    def place(acc, x):
        joins = acc["first"].isNotNull() & (tx.tokens_of(acc["words"]) < min_tokens)
        first = F.when(joins, acc["first"]).otherwise(x["section"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["section"].alias("section"), first.alias("first")))).alias("out"), first.alias("first"), F.when(joins, acc["words"] + x["words"]).otherwise(x["words"]).alias("words"))

    places = grouped.select("sk", "source", "document", F.explode(F.aggregate("xs", begin, place)["out"]).alias("s")).select("sk", "source", "document", "s.section", "s.first")
    joined = _join(marked, places, ["sk", "section"], ["source", "document"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n\n")
    head = F.min_by(F.struct(*fields), "section").alias("h")
    merged = joined.groupBy("sk", "source", "document", "first").agg(head, text.alias("text"))
    return merged.select("source", "document", F.col("first").alias("section"), *[f"h.{f}" for f in fields], "text")
