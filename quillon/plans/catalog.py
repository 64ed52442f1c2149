"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import ChunkConfig, RetrievalConfig
from quillon.functions import text as tx
from quillon.operators import cascade, chunking, dialogue, genmetrics, links, metrics, outline, reports, sampling, vectors
from quillon.plans import twins
from quillon.providers import HashedEmbedding, embed
from quillon.runtime import materialize, table
from quillon.streaming import events, thoughts

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = RetrievalConfig(adaptive_sigma=2.0, high_confidence=0.45, low_confidence=0.32)
PAIRS = CONFIG.with_(pair_scorer=True, pair_top_k=10, pair_min_score=0.05)
_REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTERED[f.__name__] = f
    return f


def _r(c: str):
    return F.round(c, 6).alias(c)


# --- the cascade: every vector whose id is divisible by 20 asks, all rows answer


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, query, qtok): the asking rows; the query is the first line of the document's text."""
    vecs = table(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.get(F.split("text", "\n"), F.lit(0)).alias("query"))
    return vecs.join(docs, "qid", "left").withColumn("qtok", tx.ranking_tokens(F.col("query")))


def _pool(spark: SparkSession, folder: str, config: RetrievalConfig = CONFIG) -> DataFrame:
    vecs = table(spark, folder, "embeddings")
    near = vectors.top_k(vecs, vecs.where("vec_id % 20 = 0"), config.pool)
    # tokens are taken once a document, before the join
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("cid"), "text", "source", tx.ranking_tokens(F.col("text")).alias("ctok"))
    return near.join(docs, "cid", "left").join(_queries(spark, folder), "qid")


def _stage(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = cascade.stages(_pool(spark, folder), CONFIG)[name]
        return out.select("qid", "cid", "rank", _r("score"))

    return run


def _pair_score():
    q, c = F.array_distinct(F.coalesce("qtok", F.array().cast("array<string>"))), F.coalesce("ctok", F.array().cast("array<string>"))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.retrieve(_pool(spark, folder), CONFIG).select("qid", "cid", "rank", _r("score"), "confidence")


for _name in ("semantic", "absolute", "adaptive", "gap", "keyword", "hybrid"):
    _REGISTERED[f"stage_{_name}"] = _stage(_name)


@query
def retrieve(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)


@query
def bm25_pool(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.bm25(cascade.absolute_filter(_pool(spark, folder), CONFIG.min_score)).select("qid", "cid", _r("bm25"))


@query
def min_max_scores(spark: SparkSession, folder: str) -> DataFrame:
    pool = cascade.absolute_filter(_pool(spark, folder), CONFIG.min_score)
    return pool.select("qid", "cid", F.round(cascade.min_max(F.col("score")), 6).alias("scaled"))


@query
def pair_rerank(spark: SparkSession, folder: str) -> DataFrame:
    out = cascade.retrieve(_pool(spark, folder, PAIRS), PAIRS, _pair_score())
    return out.select("qid", "cid", "rank", _r("hybrid_score"), _r("pair_score"), _r("score"), "confidence")


@query
def best_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.best_confidence(cascade.retrieve(_pool(spark, folder), CONFIG), _queries(spark, folder), CONFIG)


@query
def trace_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.trace(_pool(spark, folder), CONFIG).groupBy("stage_no", "stage").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("n_queries"))


# --- metrics: rows of the query's label are relevant, those of the next label somewhat


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    vecs = table(spark, folder, "embeddings").select("vec_id", "label")
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.explode(F.array(F.struct(F.col("label"), F.lit(3).alias("relevance")), F.struct((F.col("label") + 1).alias("label"), F.lit(1).alias("relevance")))).alias("x"))
    return asked.select("qid", "x.label", "x.relevance").join(vecs, "label").where("vec_id <> qid").select("qid", F.col("vec_id").alias("cid"), "relevance")


def _nearest(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vecs = table(spark, folder, "embeddings")
    return vectors.top_k(vecs, vecs.where("vec_id % 20 = 0"), k)


def _scored(spark: SparkSession, folder: str, k: int = 10, near: DataFrame | None = None) -> DataFrame:
    found = near if near is not None else _nearest(spark, folder, k)
    return metrics.per_query(_queries(spark, folder), found, _qrels(spark, folder), k)


_METRICS = ("precision", "recall", "f1", "rr", "ndcg", "ap")


@query
def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("qid", "n_results", "n_relevant", "hit", *[_r(m) for m in _METRICS])


@query
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.report(_scored(spark, folder)).select("n", *[_r(m) for m in (*_METRICS, "hit")])


@query
def eval_by_category(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"))
    return metrics.report_by_category(_scored(spark, folder), names).select("category", "n", _r("hit"), _r("recall"), _r("rr"))


@query
def worst_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("qid", _r("recall"), "hit").orderBy("recall", "hit", "qid").limit(10)


@query
def recall_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at several depths of one search."""
    out, near = None, materialize(_nearest(spark, folder, 10), "near")
    for k in (1, 3, 5, 10):
        part = metrics.report(_scored(spark, folder, k, near)).select(F.lit(k).alias("k"), _r("recall"), _r("hit"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def compare_reports(spark: SparkSession, folder: str) -> DataFrame:
    runs, near = None, materialize(_nearest(spark, folder, 10), "near")
    for k in (5, 10):
        part = metrics.report(_scored(spark, folder, k, near)).select(F.lit(f"k{k}").alias("name"), *[_r(m) for m in ("precision", "recall")])
        runs = part if runs is None else runs.unionByName(part)
    return metrics.compare(runs, "name", ["precision", "recall"])


@query
def guardrail(spark: SparkSession, folder: str) -> DataFrame:
    strict = CONFIG.with_(min_score=0.45)
    return metrics.guardrail(_queries(spark, folder), cascade.absolute_filter(_pool(spark, folder), strict.min_score))


@query
def failure_stages(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.failure_stages(_queries(spark, folder), cascade.trace(_pool(spark, folder), CONFIG), _qrels(spark, folder).where("relevance = 3"), cascade.STAGES)


@query
def failure_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = failure_stages(spark, folder)
    return rows.groupBy("failure_stage").agg(F.count("*").alias("n"), F.count_if(F.col("first_rank") <= 1).alias("top1"), F.count_if(F.col("first_rank") <= 5).alias("top5"))


@query
def neighbour_qrels(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.neighbour_qrels(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", "source", "doc_id")


@query
def passage_links(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", F.explode("relevant_texts").alias("passage"))
    return links.link_passages(items, table(spark, folder, "documents"), chunk_id="doc_id")


# --- search that is no exact SQL


@query
def approximate_search(spark: SparkSession, folder: str) -> DataFrame:
    vecs = table(spark, folder, "embeddings")
    return vectors.approximate_top_k(vecs, vecs.where("vec_id % 20 = 0"), 10).select("qid", "cid", "rank", _r("score"))


@query
def embedded_messages(spark: SparkSession, folder: str) -> DataFrame:
    return embed(table(spark, folder, "chat_requests").select("request_id", F.col("message").alias("text")), HashedEmbedding(32)).select("request_id", "text_sha256", F.size("embedding").alias("dimension"))


# --- texts


@query
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.chunk_stats(table(spark, folder, "chunks")).select("n", "tokens", _r("mean_tokens"), "min_tokens", "max_tokens", "n_tiny", "n_huge")


@query
def structure_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.structure_report(table(spark, folder, "chunks"))


@query
def unstructured_share(spark: SparkSession, folder: str) -> DataFrame:
    return reports.unstructured_share(table(spark, folder, "chunks")).select("n", _r("unstructured"))


@query
def source_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.source_report(table(spark, folder, "chunks"))


@query
def body_sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source IS NOT NULL")
    spans = docs.select("source", F.col("doc_id").alias("pos"), F.lit(False).alias("bold"), F.col("body_size").alias("size"))
    return reports.body_sizes(spans)


@query
def first_of_text(spark: SparkSession, folder: str) -> DataFrame:
    return reports.first_of_text(table(spark, folder, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "text_md5")


@query
def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    stored = docs.where("source IS NULL OR source LIKE 'saber%'").where("text IS NOT NULL").select(F.md5("text").alias("text_md5"))
    return reports.new_texts(docs.select("doc_id", "text"), stored, "text", ["doc_id"]).select("doc_id", "text_md5")


@query
def row_keys(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return chunks.select(
        "chunk_id", tx.chunk_id(F.coalesce("source", F.lit("")), F.col("config_id"), F.col("page")).alias("made_id"), tx.embedding_key(F.lit("m"), F.col("text")).alias("key"), F.md5(tx.record_key(F.lit(None).cast("string"), F.col("text"))).alias("by_text")
    ).distinct()


@query
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.clean_page_text(F.col("text")).alias("clean"))


@query
def text_parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(tx.paragraphs(F.col("text"))).alias("paragraphs"), F.size(tx.sentences(F.col("text"))).alias("sentences"))


@query
def text_metadata(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", tx.detect_section(text).alias("title"), tx.chapter_of(text).alias("chapter"), tx.topic_of(text).alias("topic"), tx.section_title_of(text, F.col("section")).alias("section_title")
    )


@query
def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", tx.breadcrumb(F.col("unit"), F.col("chapter"), F.col("topic")).alias("crumb")).distinct()


@query
def line_levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "page", "text").withColumnRenamed("doc_id", "page_key")
    return outline.lines(docs).select(F.col("key").alias("doc_id"), "line_no", "level", F.when(F.col("level") > 0, F.col("title")).alias("title"))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return outline.sections(table(spark, folder, "documents").select("source", "page", F.col("doc_id").alias("page_key"), "text", "bold_lines", "body_size"))


@query
def outline_sections(spark: SparkSession, folder: str) -> DataFrame:
    return outline.section_documents(_sections(spark, folder)).select("source", "document", "section_no", "page", "unit", "chapter", "topic", "level", "breadcrumb", "section", F.md5("text").alias("text_md5"))


@query
def merged_sections(spark: SparkSession, folder: str) -> DataFrame:
    return outline.merge_tiny(_sections(spark, folder), 200).select("source", "document", "section", "page", "unit", "chapter", "topic", "level", F.md5("text").alias("text_md5"))


@query
def chunked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(table(spark, folder, "documents"), ChunkConfig())


@query
def top_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.top_keywords(table(spark, folder, "documents"), "doc_id", "text")


@query
def keyword_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(tx.topic_keywords(F.col("text"))), " ").alias("keywords"))


@query
def keyword_queries(spark: SparkSession, folder: str) -> DataFrame:
    top = top_keywords(spark, folder).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("kw"))
    docs = table(spark, folder, "documents").select("doc_id", "section")
    return top.join(docs, "doc_id").select("doc_id", sampling.keyword_query(F.col("kw"), F.col("section")).alias("query"))


@query
def query_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.with_query_sentence(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "sentence")


@query
def previews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


# --- conversations: the requests of a session in order of sending, every second one an answer


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of all sessions; a repeated request counts once, with its first arrival."""
    rows = table(spark, folder, "chat_requests").where("session_id IS NOT NULL").groupBy("session_id", "request_id").agg(F.min("message").alias("content"), F.min("sent_at").alias("sent_at"))
    # days are the stretches of a session: counted first, then lined up within, without the content
    slim = rows.select("session_id", "request_id", "sent_at", F.to_date("sent_at").alias("day"))
    sizes = slim.groupBy("session_id", "day").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("session_id").alias("s"), F.col("day").alias("d"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = rows.withColumn("day", F.to_date("sent_at"))
    within = F.row_number().over(Window.partitionBy("session_id", "day").orderBy("sent_at", "request_id"))
    placed = placed.withColumn("within", within).join(bases, (F.col("session_id") == F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    turn = (F.col("base") + F.col("within")).cast("int")
    return placed.select("session_id", "request_id", "content", "sent_at", turn.alias("turn")).withColumn("role", F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant"))


@query
def history_trim(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.trim_history(_messages(spark, folder), 4).select("session_id", "turn", "role", "content")


@query
def follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.follow_ups(_messages(spark, folder)).select("session_id", "turn", "earlier", "follow_up")


@query
def history_context(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.history_context(_messages(spark, folder))


@query
def session_list(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).groupBy("session_id").agg(F.count("*").alias("n_messages"), F.max("sent_at").cast("double").alias("updated_at"), F.min_by("content", "turn").alias("first")).select("session_id", "n_messages", "updated_at", tx.clean_title(F.col("first")).alias("title"))


@query
def clean_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chat_requests").select("request_id", "message").distinct()
    raw = F.concat(F.lit("<think>x</think>\n"), F.col("message"), F.lit(" <think>y"))
    return rows.select("request_id", tx.clean_answer(raw, F.lit("ok")).alias("answer"), tx.clean_question(F.concat(F.lit("Pergunta: "), "message")).alias("question"), tx.is_refusal(raw).alias("refused"))


@query
def topical_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.topically_relevant(_queries(spark, folder).select("qid", "query"), cascade.retrieve(_pool(spark, folder), CONFIG).select("qid", "text").where("text IS NOT NULL"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    pool = cascade.absolute_filter(_pool(spark, folder), CONFIG.min_score).where("text IS NOT NULL")
    # scores to two places, so that both engines print the same
    rows = pool.select("qid", "rank", "text", "source", F.lit(None).cast("string").alias("breadcrumb"), F.round("score", 1).alias("score"))
    return dialogue.pack_context(rows)


@query
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@query
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.context_blocks(_packed(spark, folder))


@query
def prompt_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Where each candidate ended up: filtered, in the prompt, cut or out of it."""
    pool = cascade.absolute_filter(_pool(spark, folder), CONFIG.min_score).where("text IS NOT NULL").select("qid", "cid", "text")
    usable = pool.groupBy("qid").agg(F.max(F.length("text") >= 80).alias("usable"))
    joined = pool.join(usable, "qid").join(dialogue.context_blocks(_packed(spark, folder)), "qid", "left")
    return joined.select("qid", "cid", tx.prompt_status(F.col("text"), F.coalesce("context", F.lit("")), F.col("usable")).alias("status"))


# --- answers


@query
def tfidf_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return genmetrics.tfidf_similarity(table(spark, folder, "eval_items"), "item_id", "query", "reference_answer").select("item_id", _r("similarity"))


@query
def answer_overlap(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").withColumns(
        {"context": F.array_join(F.coalesce("relevant_texts", F.array().cast("array<string>")), " "), "answer": F.coalesce("reference_answer", F.lit(""))}
    )
    answer = F.col("answer")
    return genmetrics.with_faithfulness(items, "answer", "context").select(
        "item_id", F.round(tx.word_overlap(answer, F.col("context")), 6).alias("overlap"), _r("faithfulness"), tx.expected_found(answer, F.split("query", " ")).alias("exact"), tx.is_refusal(answer).alias("refused")
    )


@query
def answer_report(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", "category", "answerable")
    scored = items.join(answer_overlap(spark, folder), "item_id")
    out = genmetrics.answer_report(scored, "category")
    return out.select("category", "n", _r("faithfulness"), _r("exact"), _r("refusal_precision"), _r("refusal_recall"))


@query
def rouge(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", genmetrics.rouge_l("query", "reference_answer").alias("r")).select("item_id", "r.*")


@query
def vector_cosine(spark: SparkSession, folder: str) -> DataFrame:
    vecs = table(spark, folder, "embeddings")
    heads = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return vecs.join(heads, "label").select("vec_id", F.round(genmetrics.cosine(F.col("embedding"), F.col("head")), 6).alias("cosine"))


# --- samples and timings


@query
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hash_sample(table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id", 30, 42).select("doc_id")


@query
def synthetic_items(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.synthetic_items(_distinct_chunks(spark, folder), 30)


def _distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in ("text", "unit", "chapter", "page", "breadcrumb")])


@query
def chunk_groups(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.chunk_groups(_distinct_chunks(spark, folder), 2, 40)


@query
def entry_ids(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", sampling.category_of(F.coalesce("n_source_chunks", F.lit(0))).alias("kind"))
    return sampling.entry_ids(items, ["item_id"])


@query
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return reports.latencies(table(spark, folder, "events"), "value", "event_type").select("event_type", "n", _r("mean"), _r("least"), _r("largest"), _r("p50"), _r("p95"), _r("p99"))


@query
def event_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks")
    return reports.pivot(rows, "source", "config_id", [1, 2, 3, 4, 5], F.count(F.lit(1))).select("source", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"n{i}") for i in range(1, 6)])


@query
def value_growth(spark: SparkSession, folder: str) -> DataFrame:
    return reports.growth(table(spark, folder, "events"), "user_id", "event_id", "value").select("user_id", _r("first"), _r("last"), _r("growth"))


# --- streams, here over finished tables


@query
def visible_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as tokens; of every five turns of a session the second opens a reasoning block, the fourth closes it."""
    said, turn = F.coalesce("content", F.lit("")), F.col("turn") % 5
    token = F.when(turn == 2, F.concat(F.lit("<think>"), said)).when(turn == 4, F.concat(F.lit("x</think>"), said)).otherwise(said)
    tokens = _messages(spark, folder).select("session_id", F.col("turn").cast("bigint").alias("seq"), token.alias("token"))
    return thoughts.visible_tokens(tokens)


@query
def turn_events(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "chat_requests").select(F.col("request_id").cast("string").alias("session_id"), F.col("message").alias("answer"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error")).distinct()
    return events.turn_events(turns)


def queries() -> dict[str, Query]:
    from quillon.plans import more_queries

    return _REGISTERED | more_queries.queries()


def oracle_sql() -> dict[str, str]:
    from quillon.plans import more_queries

    return twins.sql() | more_queries.oracle_sql()
