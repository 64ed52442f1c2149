"""Turns of conversations answered as a table: retrieval, guardrails, prompt, model, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.config import RetrievalConfig
from quillon.functions import text as tx
from quillon.operators import cascade, dialogue, vectors
from quillon.providers import EmbeddingProvider, GenerationProvider, embed, generate


def search(queries: DataFrame, index: DataFrame, provider: EmbeddingProvider, config: RetrievalConfig, query_prefix: str = "") -> DataFrame:
    """Candidates (qid, cid, score, rank, text, source, breadcrumb, qtok, ctok) of queries (qid bigint, query)."""
    asked = embed(queries.withColumn("__q", F.concat(F.lit(query_prefix), "query")), provider, "__q").drop("__q")
    # negative ids keep queries apart from rows of the index
    near = vectors.top_k(index, asked.withColumn("vec_id", -1 - F.col("qid")), config.pool).withColumn("qid", -1 - F.col("qid"))
    rows = index.select(F.col("vec_id").alias("cid"), "text", "source", "breadcrumb", tx.ranking_tokens(F.col("text")).alias("ctok"))
    return near.join(rows, "cid").join(queries.select("qid", tx.ranking_tokens(F.col("query")).alias("qtok")), "qid")


def answer(turns: DataFrame, history: DataFrame, index: DataFrame, embedder: EmbeddingProvider, generator: GenerationProvider, config: RetrievalConfig | None = None, history_turns: int = 4) -> DataFrame:
    """(qid, session_id, answer, notice, n_chunks, status) of turns (qid, session_id, message).

    A message that refers to earlier ones is searched with their subject words. Turns without
    results, or with results off their topic, get the refusal and never reach the model; the
    others get a prompt of the packed context, the trimmed history and the message.
    """
    config = config or RetrievalConfig()
    earlier = history.groupBy("session_id").agg(F.count("*").alias("earlier"))
    context = dialogue.history_context(history)
    base = turns.join(earlier, "session_id", "left").join(context, "session_id", "left")
    refers = dialogue.is_follow_up(F.col("message"), F.coalesce("earlier", F.lit(0))) & (F.coalesce("context", F.lit("")) != "")
    queries = base.select("qid", "session_id", "message", F.when(refers, F.concat_ws(" ", "message", "context")).otherwise(F.col("message")).alias("query"))
    found = cascade.retrieve(search(queries.select("qid", "query"), index, embedder, config), config)
    counts = found.groupBy("qid").agg(F.count("*").alias("n_chunks"), F.max("score").alias("best"))
    on_topic = dialogue.topically_relevant(queries.select("qid", "query"), found.select("qid", "text"))
    blocks = dialogue.context_blocks(dialogue.pack_context(found.select("qid", "rank", "text", "source", "breadcrumb", "score")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    past = dialogue.trim_history(history, history_turns).groupBy("session_id").agg(said.alias("said"))
    joined = queries.join(counts, "qid", "left").join(on_topic, "qid", "left").join(blocks.withColumnRenamed("context", "block"), "qid", "left").join(past, "session_id", "left")
    status = F.when(F.col("n_chunks").isNull(), "nothing found").when(~F.coalesce("relevant", F.lit(False)), "off topic").otherwise("answered")
    marked = joined.withColumn("status", status)
    refused = marked.where("status <> 'answered'").withColumn("answer", F.lit(tx.REFUSAL)).withColumn("notice", F.lit(""))
    prompt = F.concat_ws("\n\n", "block", F.coalesce("said", F.lit("")), "message")
    told = marked.where("status = 'answered'").withColumn("answer", tx.clean_answer(generate(generator, prompt), F.col("message"))).withColumn("notice", cascade.confidence_notice(F.col("best")))
    kept = ["qid", "session_id", "answer", "notice", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "status"]
    return told.select(*kept).unionByName(refused.select(*kept))
