"""Failure analysis, details and traces of a retrieval, as tables.

``trace`` is what ``cascade.trace`` gives, rows (stage_no, stage, qid, cid, rank, score); texts
come by a join on ``cid`` and are cut to previews before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as tx
from quillon.operators.links import link_passages


def link_benchmark(items: DataFrame, chunks: DataFrame, item_id: str = "id", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """The items with ``relevant_chunks`` filled from their ``relevant_texts`` where they have none.

    A passage links to the chunks in whose beginning its own beginning lies; linked chunks have
    relevance 3 and are in the order of their ids. Items without passages or links stay as they are.
    """
    bare = F.coalesce(F.size("relevant_chunks"), F.lit(0)) <= 0
    asked = items.where(bare).select(F.col(item_id).alias("item_id"), F.explode("relevant_texts").alias("passage"))
    met = link_passages(asked, chunks, chunk_id=chunk_id, text=text)
    kind = items.schema["relevant_chunks"].dataType.simpleString()
    found = met.where("cast(chunk AS string) <> ''").groupBy(F.col("item").alias("__item")).agg(
        F.transform(F.array_sort(F.collect_set(F.col("chunk").cast("string"))), lambda c: F.struct(c.alias("chunk_id"), F.lit(3).alias("relevance"))).cast(kind).alias("__linked")
    )
    joined = items.join(found, items[item_id] == found["__item"], "left")
    return joined.withColumn("relevant_chunks", F.when(bare & F.col("__linked").isNotNull(), F.col("__linked")).otherwise(F.col("relevant_chunks"))).drop("__item", "__linked")


def effective_qrels(results: DataFrame, qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, cid, relevance) by which each query is scored, falling back on its passages' beginnings.

    ``results`` (qid, cid, text) with cid as text, ``qrels`` (qid, cid, relevance), ``passages``
    (qid, passage). A passage stands by its first 64 characters. The passages take the place of
    the ids where there are none, or where no returned id is relevant while the beginning of a
    returned text is that of a passage.
    """
    begins = passages.select("qid", tx.strip(F.substring("passage", 1, 64)).alias("cid")).where("cid IS NOT NULL").distinct()
    named = qrels.select("qid").distinct().withColumn("named", F.lit(True))
    met = results.select("qid", "cid").join(qrels.select("qid", "cid").distinct(), ["qid", "cid"], "left_semi").select("qid").distinct().withColumn("met", F.lit(True))
    shown = results.select("qid", tx.strip(F.substring("text", 1, 64)).alias("cid")).join(begins, ["qid", "cid"], "left_semi").select("qid").distinct().withColumn("shown", F.lit(True))
    every = qrels.select("qid").union(passages.select("qid")).distinct().join(named, "qid", "left").join(met, "qid", "left").join(shown, "qid", "left")
    by_text = F.col("named").isNull() | (F.col("met").isNull() & F.col("shown").isNotNull())
    chosen = every.select("qid", by_text.alias("by_text"))
    texts = begins.join(chosen.where("by_text").select("qid"), "qid", "left_semi").select("qid", "cid", F.lit(1).alias("relevance"))
    ids = qrels.join(chosen.where("NOT by_text").select("qid"), "qid", "left_semi").select("qid", "cid", F.col("relevance").cast("int").alias("relevance"))
    return ids.unionByName(texts)


def expected_chunks(qrels: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """(qid, cid, relevance, preview, source, page) of the chunks that a query should find; blanks for those that are not stored."""
    stored = chunks.select(F.col(chunk_id).alias("cid"), tx.preview(F.col("text")).alias("preview"), "source", "page")
    blank = F.lit("")
    joined = qrels.select("qid", "cid", F.coalesce("relevance", F.lit(3)).alias("relevance")).join(stored, "cid", "left")
    return joined.select("qid", "cid", "relevance", F.coalesce("preview", blank).alias("preview"), F.coalesce("source", blank).alias("source"), "page")


def retrieved_chunks(results: DataFrame, qrels: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """(qid, rank, cid, score, preview, source, page, is_relevant) in the order returned, scores to four places."""
    stored = chunks.select(F.col(chunk_id).alias("cid"), tx.preview(F.col("text")).alias("preview"), "source", "page")
    wanted = qrels.where("relevance > 0").select("qid", "cid").distinct().withColumn("is_relevant", F.lit(True))
    joined = results.select("qid", "cid", "rank", "score").join(stored, "cid", "left").join(wanted, ["qid", "cid"], "left")
    return joined.select(
        "qid", "rank", "cid", F.round("score", 4).alias("score"), F.coalesce("preview", F.lit("")).alias("preview"), F.coalesce("source", F.lit("")).alias("source"), "page",
        F.coalesce("is_relevant", F.lit(False)).alias("is_relevant"),
    )


def failure_records(failures: DataFrame, items: DataFrame, failures_only: bool = False, query_id=None) -> DataFrame:
    """(qid, category, hit, first_rank, failure_stage): what ``metrics.failure_stages`` found, by item.

    Only the misses or only one query if asked for; misses without a stage had nothing to find.
    """
    named = failures.join(items.select("qid", "category"), "qid", "left").withColumn("category", F.coalesce("category", F.lit("")))
    if failures_only:
        named = named.where("NOT hit")
    if query_id is not None:
        named = named.where(F.col("qid") == query_id)
    return named.select("qid", "category", "hit", "first_rank", "failure_stage")


def failure_summary(records: DataFrame) -> DataFrame:
    """(part, name, n, hits): all queries, misses by stage, and hits by category."""
    whole = records.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).select(F.lit("all").alias("part"), F.lit("").alias("name"), "n", "hits")
    stage = F.coalesce("failure_stage", F.lit("nothing expected"))
    stages = records.where("NOT hit").groupBy(stage.alias("name")).agg(F.count("*").alias("n")).select(F.lit("stage").alias("part"), "name", "n", F.lit(0).cast("bigint").alias("hits"))
    label = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    kinds = records.groupBy(label.alias("name")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).select(F.lit("category").alias("part"), "name", "n", "hits")
    return whole.unionByName(stages).unionByName(kinds)


def snapshots(trace: DataFrame, texts: DataFrame, characters: int = 80) -> DataFrame:
    """(qid, stage_no, stage, rank, cid, score, preview): every stage's candidates, scores to four places, previews on one line."""
    shown = texts.select("cid", F.replace(F.substring("text", 1, characters), F.lit("\n"), F.lit(" ")).alias("preview"))
    return trace.join(shown, "cid", "left").select("qid", "stage_no", "stage", "rank", "cid", F.round("score", 4).alias("score"), F.coalesce("preview", F.lit("")).alias("preview"))


def trace_summaries(shots: DataFrame, queries: DataFrame, stages: tuple[str, ...], most: int = 5) -> DataFrame:
    """(qid, summary): each stage's size and best candidates as one text.

    ``queries`` (qid, query). At most ``most`` lines a stage are gathered.
    """
    place = F.row_number().over(Window.partitionBy("qid", "stage_no").orderBy("rank"))
    sizes = shots.groupBy("qid", "stage_no").agg(F.count("*").alias("n"))
    line = F.format_string("  %s score=%.4f \"%s\"", F.col("cid").cast("string"), F.col("score").cast("double"), F.substring("preview", 1, 60))
    best = shots.withColumn("place", place).where(F.col("place") <= most).withColumn("line", line).groupBy("qid", "stage_no").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(stages)]))
    grid = queries.select("qid", "query", numbered.alias("s")).select("qid", "query", "s.stage_no", "s.stage")
    full = grid.join(sizes, ["qid", "stage_no"], "left").join(best, ["qid", "stage_no"], "left")
    n = F.coalesce("n", F.lit(0))
    head = F.format_string("[%s] %d candidates", F.col("stage"), n)
    more = F.when(n > most, F.array(F.format_string("  ... and %d more", n - most))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(head), F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>")), more)
    text = full.select("qid", "query", "stage_no", n.alias("n"), F.array_join(lines, "\n").alias("part")).groupBy("qid", "query").agg(
        F.array_sort(F.collect_list(F.struct("stage_no", "part"))).alias("parts"), F.max_by("n", "stage_no").alias("final")
    )
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    return text.select("qid", F.concat(F.lit("QUERY: "), F.coalesce("query", F.lit("")), F.lit("\n"), body, F.lit("\nFINAL: "), F.col("final").cast("string"), F.lit(" results")).alias("summary"))


def trace_json(trace: DataFrame, queries: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(qid, trace): the sizes of each query's stages and of its result as JSON."""
    sizes = trace.groupBy("qid", "stage_no").agg(F.count("*").alias("n"))
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(stages)]))
    grid = queries.select("qid", numbered.alias("s")).select("qid", "s.stage_no", "s.stage").join(sizes, ["qid", "stage_no"], "left")
    listed = F.array_sort(F.collect_list(F.struct("stage_no", "stage", F.coalesce("n", F.lit(0)).alias("count"))))
    by = grid.groupBy("qid").agg(F.transform(listed, lambda s: F.struct(s["stage"].alias("stage"), s["count"].alias("count"))).alias("stages"), F.coalesce(F.max_by("n", "stage_no"), F.lit(0)).alias("final_count"))
    return by.select("qid", F.to_json(F.struct("stages", "final_count")).alias("trace"))


def needle_positions(trace: DataFrame, texts: DataFrame, needles: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(qid, stage, candidates, position, score): where in each stage the first text with the query's needle stands.

    ``texts`` (cid, text), ``needles`` (qid, needle), compared in lower case; null positions where
    no candidate holds it. A stage without candidates has a row too.
    """
    asked = needles.select("qid", F.lower("needle").alias("needle"))
    joined = trace.join(asked, "qid").join(texts.select("cid", "text"), "cid", "left")
    holds = F.coalesce(F.contains(F.lower("text"), F.col("needle")), F.lit(False))
    found = joined.groupBy("qid", "stage_no").agg(F.count("*").alias("n"), F.min(F.when(holds, F.struct("rank", "score"))).alias("first"))
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(stages)]))
    grid = asked.select("qid", numbered.alias("s")).select("qid", "s.stage_no", "s.stage")
    return grid.join(found, ["qid", "stage_no"], "left").select(
        "qid", "stage", F.coalesce("n", F.lit(0)).alias("candidates"), F.col("first.rank").alias("position"), F.round("first.score", 3).alias("score")
    )


def chunk_reports(results: DataFrame, statuses: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, report): what a query found, where each row ended up and whether its topic was met, as one text.

    ``results`` (qid, cid, rank, text, source, score), ``statuses`` (qid, cid, status), ``relevant``
    (qid, relevant), ``queries`` (qid, query). A query's results are few, as the search bounds them.
    """
    line = F.format_string("[#%d] score=%.3f %s (%d chars) %s", F.col("rank"), F.col("score").cast("double"), F.coalesce("status", F.lit("out")), F.length(tx.strip(F.col("text"))), F.coalesce("source", F.lit("desconhecido")))
    rows = results.join(statuses, ["qid", "cid"], "left").select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    full = queries.select("qid", "query").join(rows, "qid", "left").join(relevant, "qid", "left")
    verdict = F.when(F.coalesce("relevant", F.lit(False)), "on topic").otherwise("off topic")
    body = F.when(F.col("lines").isNull(), F.lit("nothing found")).otherwise(F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"), verdict))
    return full.select("qid", F.concat(F.coalesce("query", F.lit("")), F.lit("\n"), body).alias("report"))


def metric_lines(report: DataFrame, metrics: tuple[str, ...], width: int = 20) -> DataFrame:
    """(line_no, line): a report of one row as a table of text, a bar for each metric."""
    parts = [F.struct(F.lit(i).alias("line_no"), F.lit(m).alias("name"), F.col(m).cast("double").alias("v")) for i, m in enumerate(metrics)]
    long = report.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    value = F.coalesce("v", F.lit(0.0))
    bar = F.repeat(F.lit("#"), F.floor(value * width).cast("int"))
    return long.select("line_no", F.format_string("%s %.4f %s", F.rpad("name", 12, " "), value, bar).alias("line"))


def deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, a, b, delta): two reports side by side, rows of either."""
    long = lambda df, name: df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(key, "x.metric", F.col("x.v").alias(name))
    return long(a, "a").join(long(b, "b"), [key, "metric"], "full").withColumn("delta", F.col("b") - F.col("a"))


def model_ranking(runs: DataFrame, model: str, correct: str, speed: str) -> DataFrame:
    """(model, n, accuracy, speed, place, most_accurate, fastest): models by accuracy, then speed.

    ``runs`` has a row for each answer; null measures do not count. Models are few.
    """
    means = runs.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(speed).alias("speed"))
    everyone = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everyone.orderBy(F.desc("accuracy"), F.desc("speed"), "model"))
    return means.withColumns({"place": place, "most_accurate": F.col("accuracy") == F.max("accuracy").over(everyone), "fastest": F.col("speed") == F.max("speed").over(everyone)})

