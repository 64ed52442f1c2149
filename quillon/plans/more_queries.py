"""Registered queries over stores, files, analyses, generated sets and streams, with their SQL twins.

What a store writes goes to a folder of this application in the shared folder and is read back,
so the twin compares what came out with the tables that went in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.config import ChunkConfig, RetrievalConfig
from quillon.functions import text as tx
from quillon.operators import analysis, cascade, datasets, dialogue, genmetrics, links, metrics, reports, sampling, vectors
from quillon.plans import answering, catalog, evaluating, twins
from quillon.providers import CountingQuestion, FirstSentence, HashedEmbedding, LengthEmbedding, embed
from quillon.runtime import materialize, own_tables, table
from quillon.sources import files, stores
from quillon.streaming import events, thoughts

_REGISTERED: dict[str, catalog.Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: catalog.Query) -> catalog.Query:
        _REGISTERED[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{own_tables(spark)}/{name}-{uuid.uuid4().hex}"


# --- files and stores

_FILE_TEXT = """CASE WHEN n % 3 = 2 THEN query || coalesce(' ' || reference_answer, '') ELSE query || chr(10) || coalesce(reference_answer, '') END"""


@query(f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS n FROM eval_items)
  SELECT item_id || CASE n % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.json' END AS source, {_FILE_TEXT} AS text FROM i""")
def loaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item written as a file of one of three kinds, and all files loaded."""
    items = table(spark, folder, "eval_items").select("item_id", "query", "reference_answer").orderBy("item_id").collect()
    contents = []
    for n, r in enumerate(items):
        name = r.item_id + (".txt", ".MD", ".json")[n % 3]
        contents.append((name, files.json_text({"n": n, "q": r.query, "a": r.reference_answer}) if n % 3 == 2 else f"{r.query}\n{r.reference_answer or ''}"))
    path = _folder(spark, "files")
    files.write_files(spark, path, contents + [("left_out.csv", "x")])
    return files.load_documents(spark, path).select("source", "text")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY text")
def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """All documents added to an index in two overlapping parts, the second of which brings few new texts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = stores.VectorIndex(spark, _folder(spark, "index"), vectors.signature("none"))
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    index.add(docs.where(F.col("doc_id") <= middle), ["doc_id"])
    index.add(docs, ["doc_id"])
    return index.rows().select("doc_id", "text_md5")


@query("SELECT count(DISTINCT text) AS n, true AS readable, false AS broken FROM documents WHERE text IS NOT NULL")
def index_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The size of a stored index, whether it loads, and whether one that was never written does."""
    index = stores.VectorIndex(spark, _folder(spark, "index"), vectors.signature("none"))
    index.add(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    missing = stores.VectorIndex(spark, _folder(spark, "index"), vectors.signature("none"))
    return spark.createDataFrame([(index.size(), index.load(), missing.load())], "n bigint, readable boolean, broken boolean")


def _linked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of both layouts: graded chunks where the category is not null, plain lists elsewhere."""
    items = table(spark, folder, "eval_items")
    texts = F.coalesce("relevant_texts", F.array().cast("array<string>"))
    graded = F.transform(texts, lambda x, i: F.struct(F.concat_ws("-", "item_id", i.cast("string")).alias("chunk_id"), i.alias("relevance")))
    plain = F.transform(texts, lambda x, i: F.concat_ws("-", "item_id", i.cast("string")))
    even = F.length("query") % 2 == 0
    return items.select(
        F.col("item_id").alias("id"), "query", "category", "answerable", F.when(even, graded).alias("relevant_chunks"), F.when(~even, plain).alias("relevant_chunk_ids"),
        "relevant_texts", "reference_answer", "n_source_chunks", "source_breadcrumb",
    )


@query("""SELECT item_id AS id, query, category, answerable, n_source_chunks, source_breadcrumb, reference_answer, len(relevant_texts) AS n_texts,
  array_to_string(relevant_texts, '|') AS texts FROM eval_items""")
def eval_items_read(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation items written and read back."""
    path = _folder(spark, "items")
    stores.write_eval_items(_linked_items(spark, folder).repartition(3), path)
    read = stores.read_eval_items(spark, path)
    n = F.when(F.col("relevant_texts").isNotNull(), F.size("relevant_texts")).cast("bigint")
    return read.select("id", "query", "category", "answerable", "n_source_chunks", "source_breadcrumb", "reference_answer", n.alias("n_texts"), F.array_join("relevant_texts", "|").alias("texts"))


@query("""WITH t AS (SELECT item_id, query, unnest(range(len(relevant_texts))) AS i FROM eval_items)
  SELECT item_id AS qid, item_id || '-' || i AS cid, CAST(CASE WHEN length(query) % 2 = 0 THEN i ELSE 1 END AS INT) AS relevance FROM t WHERE length(query) % 2 = 1 OR i > 0""")
def item_relevances(spark: SparkSession, folder: str) -> DataFrame:
    """Relevances of items of both layouts after a round trip."""
    path = _folder(spark, "items")
    stores.write_eval_items(_linked_items(spark, folder), path)
    return stores.item_qrels(stores.read_eval_items(spark, path))


@query(f"""{twins._MESSAGES} SELECT session_id AS id, CASE WHEN max(turn) % 2 = 0 THEN 'even' ELSE 'New Chat' END AS title, epoch_us(max(sent_at)) / 1e6 AS updated_at, CAST(count(*) AS INT) AS n_messages
  FROM said GROUP BY session_id HAVING max(turn) % 5 <> 0""")
def session_store(spark: SparkSession, folder: str) -> DataFrame:
    """All sessions stored in two batches of turns, some renamed, some deleted, and listed."""
    said = catalog._messages(spark, folder).select(F.col("session_id").alias("id"), "role", "content", F.col("sent_at").cast("double").alias("ts"), "turn")
    said = materialize(said, "said")
    log = stores.Sessions(spark, _folder(spark, "sessions"))
    log.append_turns(said.where("turn <= 2").drop("turn"))
    log.append_turns(said.where("turn > 2").drop("turn"))
    lengths = said.groupBy("id").agg(F.max("turn").alias("n"))
    log.set_titles(lengths.where("n % 2 = 0").select("id", F.lit("even").alias("title")))
    log.delete_all(lengths.where("n % 5 = 0").select("id"))
    return log.list().select("id", "title", "updated_at", "n_messages")


@query("""SELECT sha256('hashed-32::' || message) AS text_sha256, substring(sha256('hashed-32::' || message), 1, 2) AS shard, 32 AS dimension
  FROM chat_requests WHERE message IS NOT NULL GROUP BY message""")
def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all messages stored in two steps, the second of which takes what the first has left."""
    cache = stores.EmbeddingCache(spark, _folder(spark, "cache"))
    texts = table(spark, folder, "chat_requests").select("request_id", F.col("message").alias("text"))
    cache.add(embed(texts.where("request_id <= 1000"), HashedEmbedding(32)))
    cache.add(embed(texts, HashedEmbedding(32), cache=cache.rows()))
    return cache.rows().select("text_sha256", F.substring("text_sha256", 1, 2).alias("shard"), F.size("embedding").alias("dimension"))


@query(" UNION ALL ".join(f"(SELECT 'k{k}' AS run, n, recall, hit FROM ({twins._metrics(k)} SELECT count(*) AS n, {twins._MEAN} FROM scored))" for k in (5, 10)))
def saved_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports saved as files and read back side by side."""
    near = materialize(catalog._nearest(spark, folder, 10), "near")
    paths = {}
    for k in (5, 10):
        paths[f"k{k}"] = _folder(spark, "report")
        stores.save_table(metrics.report(catalog._scored(spark, folder, k, near)), paths[f"k{k}"])
    return stores.read_tables(spark, paths, "run").select("run", "n", catalog._r("recall"), catalog._r("hit"))


# --- failures, traces and details

_LINKED = "qrels AS (SELECT q.vec_id AS qid, e.vec_id AS cid FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"
_PREVIEW = "CASE WHEN length({0}) > 200 THEN substring({0}, 1, 200) || '…' ELSE {0} END"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("cid"), "text", "source", "page")


def _trace(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(cascade.trace(catalog._pool(spark, folder), catalog.CONFIG), "trace")


@query(f"""{twins._FAIL} SELECT f.qid, coalesce(d.lang, '') AS category, f.hit, CAST(f.first_rank AS INT) AS first_rank, f.failure_stage FROM failed f LEFT JOIN documents d ON d.doc_id = f.qid WHERE NOT f.hit""")
def failed_queries(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"))
    return analysis.failure_records(catalog.failure_stages(spark, folder), names, failures_only=True)


@query(f"""{twins._FAIL}, r AS (SELECT f.*, coalesce(d.lang, '') AS category FROM failed f LEFT JOIN documents d ON d.doc_id = f.qid)
  SELECT 'all' AS part, '' AS name, count(*) AS n, count(*) FILTER (hit) AS hits FROM r UNION ALL
  SELECT 'stage', coalesce(failure_stage, 'nothing expected'), count(*), 0 FROM r WHERE NOT hit GROUP BY failure_stage UNION ALL
  SELECT 'category', coalesce(nullif(category, ''), 'uncategorized'), count(*), count(*) FILTER (hit) FROM r GROUP BY 2""")
def failure_report(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"))
    records = materialize(analysis.failure_records(catalog.failure_stages(spark, folder), names), "records")
    return analysis.failure_summary(records)


_SHOTS = f"{twins._CASCADE}, {twins._TRACE.replace('cid, rank FROM', 'cid, rank, score FROM')}, shots AS (SELECT t.qid, t.stage_no, t.stage, CAST(t.rank AS INT) AS rank, t.cid, round(t.score, 4) AS score, replace(substring(coalesce(d.text, ''), 1, 80), chr(10), ' ') AS preview FROM trace t LEFT JOIN documents d ON d.doc_id = t.cid)"


@query(f"{_SHOTS} SELECT * FROM shots")
def trace_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.snapshots(_trace(spark, folder), _texts(spark, folder))


@query(f"""{_SHOTS}, grid AS (SELECT q.qid, q.query, s.stage_no, s.stage FROM queries q, (SELECT unnest(range({len(twins._STAGES)})) AS stage_no, unnest({twins._list(twins._STAGES)}) AS stage) s),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, stage_no ORDER BY rank) AS place, count(*) OVER (PARTITION BY qid, stage_no) AS n FROM shots),
  lines AS (SELECT qid, stage_no, max(n) AS n, string_agg('  ' || cid || ' score=' || printf('%.4f', score) || ' "' || substring(preview, 1, 60) || '"', chr(10) ORDER BY place) FILTER (place <= 5) AS body FROM ranked GROUP BY qid, stage_no),
  parts AS (SELECT g.qid, g.query, g.stage_no, coalesce(l.n, 0) AS n, '[' || g.stage || '] ' || coalesce(l.n, 0) || ' candidates' || coalesce(chr(10) || l.body, '') || CASE WHEN l.n > 5 THEN chr(10) || '  ... and ' || (l.n - 5) || ' more' ELSE '' END AS part
    FROM grid g LEFT JOIN lines l ON l.qid = g.qid AND l.stage_no = g.stage_no)
  SELECT qid, 'QUERY: ' || coalesce(query, '') || chr(10) || string_agg(part, chr(10) ORDER BY stage_no) || chr(10) || 'FINAL: ' || max_by(n, stage_no) || ' results' AS summary FROM parts GROUP BY qid, query""")
def trace_summaries(spark: SparkSession, folder: str) -> DataFrame:
    shots = materialize(trace_snapshots(spark, folder), "shots")
    return analysis.trace_summaries(shots, catalog._queries(spark, folder).select("qid", "query"), cascade.STAGES)


@query(f"""{_SHOTS}, needles AS (SELECT qid, qtok[1] AS needle FROM queries),
  held AS (SELECT t.qid, t.stage_no, count(*) AS n, min(CASE WHEN contains(lower(d.text), n.needle) THEN t.rank END) AS position, min_by(t.score, t.rank) FILTER (contains(lower(d.text), n.needle)) AS score
    FROM trace t JOIN needles n ON n.qid = t.qid LEFT JOIN documents d ON d.doc_id = t.cid GROUP BY t.qid, t.stage_no)
  SELECT n.qid, s.stage, coalesce(h.n, 0) AS candidates, CAST(h.position AS INT) AS position, round(h.score, 3) AS score
  FROM needles n CROSS JOIN (SELECT unnest(range({len(twins._STAGES)})) AS stage_no, unnest({twins._list(twins._STAGES)}) AS stage) s LEFT JOIN held h ON h.qid = n.qid AND h.stage_no = s.stage_no""")
def needle_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first texts with the first word of each query stand in every stage."""
    needles = catalog._queries(spark, folder).select("qid", F.get("qtok", F.lit(0)).alias("needle"))
    return analysis.needle_positions(_trace(spark, folder), _texts(spark, folder), needles, cascade.STAGES)


@query(f"""WITH {_LINKED} SELECT r.qid, r.cid, 3 AS relevance, coalesce({_PREVIEW.format('d.text')}, '') AS preview, coalesce(d.source, '') AS source, d.page FROM qrels r LEFT JOIN documents d ON d.doc_id = r.cid""")
def expected_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.expected_chunks(catalog._qrels(spark, folder).where("relevance = 3"), table(spark, folder, "documents"), "doc_id")


@query(f"""WITH {twins._near(10)}, {_LINKED} SELECT n.qid, CAST(n.rank AS INT) AS rank, n.cid, round(n.score, 4) AS score, coalesce({_PREVIEW.format('d.text')}, '') AS preview, coalesce(d.source, '') AS source, d.page,
  r.cid IS NOT NULL AS is_relevant FROM near n LEFT JOIN documents d ON d.doc_id = n.cid LEFT JOIN qrels r ON r.qid = n.qid AND r.cid = n.cid""")
def retrieved_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.retrieved_chunks(catalog._nearest(spark, folder, 10), catalog._qrels(spark, folder).where("relevance = 3"), table(spark, folder, "documents"), "doc_id")




def _begin(x: str) -> str:
    return twins._strip(f"substring({x}, 1, 64)")


_FALLBACK = f"""WITH {twins._near(10)}, {_LINKED.replace('AS cid FROM', "AS c FROM")},
  res AS (SELECT n.qid, CAST(n.cid AS VARCHAR) AS cid, {_begin('d.text')} AS p FROM near n LEFT JOIN documents d ON d.doc_id = n.cid),
  ids AS (SELECT qid, CASE WHEN qid % 40 = 0 THEN 'x' ELSE '' END || c AS cid FROM qrels WHERE qid % 60 <> 0),
  texts AS (SELECT DISTINCT n.qid, {_begin('d.text')} AS cid FROM near n JOIN documents d ON d.doc_id = n.cid WHERE n.rank = 3 AND d.text IS NOT NULL),
  asked AS (SELECT qid, qid NOT IN (SELECT qid FROM ids) OR (qid NOT IN (SELECT ids.qid FROM ids JOIN res ON res.qid = ids.qid AND res.cid = ids.cid) AND qid IN (SELECT t.qid FROM texts t JOIN res ON res.qid = t.qid AND res.p = t.cid)) AS by_text
    FROM (SELECT qid FROM ids UNION SELECT qid FROM texts))
  SELECT qid, cid, 3 AS relevance FROM ids WHERE qid IN (SELECT qid FROM asked WHERE NOT by_text) UNION ALL SELECT qid, cid, 1 FROM texts WHERE qid IN (SELECT qid FROM asked WHERE by_text)"""


@query(_FALLBACK)
def prefix_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """What counts as relevant where a part of the queries has ids that no row bears, or none."""
    near = materialize(catalog._nearest(spark, folder, 10).join(_texts(spark, folder), "cid", "left"), "near")
    made = F.concat(F.when(F.col("qid") % 40 == 0, "x").otherwise(""), F.col("cid").cast("string"))
    ids = catalog._qrels(spark, folder).where("relevance = 3 AND qid % 60 <> 0").select("qid", made.alias("cid"), "relevance")
    passages = near.where("rank = 3 AND text IS NOT NULL").select("qid", F.col("text").alias("passage"))
    return analysis.effective_qrels(near.select("qid", F.col("cid").cast("string").alias("cid"), "text"), ids, passages)


def _head(x: str) -> str:
    return f"substring({twins._strip(x)}, 1, 120)"



@query(f"""WITH {twins._QUERIES}, p AS (SELECT DISTINCT qid, {_head('query')} AS p FROM queries), d AS (SELECT doc_id, {_head('text')} AS h FROM documents)
  SELECT DISTINCT p.qid AS item, d.doc_id AS chunk FROM p JOIN d ON contains(d.h, p.p) WHERE p.p <> ''""")
def line_links(spark: SparkSession, folder: str) -> DataFrame:
    """The first lines of all queries looked for in the beginnings of all documents."""
    return links.link_passages(catalog._queries(spark, folder).select("qid", "query"), table(spark, folder, "documents"), "qid", "query", "doc_id")


@query(f"""WITH i AS (SELECT item_id, [relevant_texts[1]] AS texts, category = 'factual' AS has FROM eval_items),
  c AS (SELECT item_id || '-' || u.i AS cid, {_head('u.x')} AS h FROM (SELECT item_id, unnest(relevant_texts) AS x, unnest(range(len(relevant_texts))) AS i FROM eval_items) u),
  m AS (SELECT DISTINCT i.item_id, c.cid FROM i JOIN c ON contains(c.h, {_head('i.texts[1]')}) WHERE i.texts[1] IS NOT NULL AND NOT coalesce(i.has, false) AND {_head('i.texts[1]')} <> ''),
  l AS (SELECT item_id, string_agg(cid || ':3', ' ' ORDER BY cid) AS linked FROM m GROUP BY item_id)
  SELECT e.item_id AS id, CASE WHEN coalesce(e.category = 'factual', false) THEN 'own:1' ELSE coalesce(l.linked, '') END AS linked FROM eval_items e LEFT JOIN l ON l.item_id = e.item_id""")
def linked_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Items without relevant chunks linked to the stored passages of all items."""
    items = table(spark, folder, "eval_items")
    own = F.when(F.col("category") == "factual", F.array(F.struct(F.lit("own").alias("chunk_id"), F.lit(1).alias("relevance")))).otherwise(F.array().cast("array<struct<chunk_id:string,relevance:int>>"))
    asked = items.select(F.col("item_id").alias("id"), F.array(F.get("relevant_texts", F.lit(0))).alias("relevant_texts"), own.alias("relevant_chunks"))
    stored = items.select("item_id", F.posexplode("relevant_texts").alias("i", "text")).select(F.concat_ws("-", "item_id", "i").alias("chunk_id"), "text")
    linked = F.transform("relevant_chunks", lambda c: F.concat_ws(":", c["chunk_id"], c["relevance"].cast("string")))
    return analysis.link_benchmark(asked, stored).select("id", F.array_join(linked, " ").alias("linked"))


@query(f"{twins._CASCADE} SELECT count(*) AS n, count(*) FILTER (retrieved = 0) AS passed, round(avg(CAST(retrieved = 0 AS INT)), 6) AS rate FROM (SELECT q.qid, count(s.cid) AS retrieved FROM queries q LEFT JOIN semantic s ON s.qid = q.qid AND s.score >= 0.45 GROUP BY q.qid)")
def guardrail_rate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.guardrail_rate(catalog.guardrail(spark, folder)).select("n", "passed", catalog._r("rate"))


@query(f"{twins._CASCADE} SELECT q.qid, CASE WHEN max(f.score) IS NULL THEN '' WHEN max(f.score) < 0.45 THEN 'low' WHEN max(f.score) < 0.65 THEN 'medium' ELSE '' END AS notice FROM queries q LEFT JOIN final f USING (qid) GROUP BY q.qid")
def confidence_notices(spark: SparkSession, folder: str) -> DataFrame:
    best = cascade.retrieve(catalog._pool(spark, folder), catalog.CONFIG).groupBy("qid").agg(F.max("score").alias("best"))
    return catalog._queries(spark, folder).select("qid").join(best, "qid", "left").select("qid", cascade.confidence_notice(F.col("best")).alias("notice"))


_METRICS = ("precision", "recall", "f1", "rr", "ndcg", "ap")


@query(f"""{twins._metrics(10)}, r AS (SELECT {twins._MEAN} FROM scored), l AS (SELECT unnest(range({len(_METRICS)})) AS line_no, unnest([{', '.join(_METRICS)}]) AS v, unnest({twins._list(_METRICS)}) AS m FROM r)
  SELECT CAST(line_no AS INT) AS line_no, rpad(m, 12, ' ') || ' ' || printf('%.4f', v) || ' ' || repeat('#', CAST(floor(v * 20) AS INT)) AS line FROM l""")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    report = metrics.report(catalog._scored(spark, folder)).select(*[catalog._r(m) for m in _METRICS])
    return analysis.metric_lines(report, _METRICS)


@query("""WITH """ + ", ".join(f"r{k} AS (SELECT coalesce(nullif(d.lang, ''), 'uncategorized') AS category, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM ({twins._metrics(k)} SELECT * FROM scored) s LEFT JOIN documents d ON d.doc_id = s.qid GROUP BY 1)" for k in (5, 10)) + """
  , l5 AS (SELECT category, 'recall' AS metric, recall AS a FROM r5 UNION ALL SELECT category, 'hit', hit FROM r5), l10 AS (SELECT category, 'recall' AS metric, recall AS b FROM r10 UNION ALL SELECT category, 'hit', hit FROM r10)
  SELECT category, metric, a, b, round(b - a, 6) AS delta FROM l5 FULL JOIN l10 USING (category, metric)""")
def report_deltas(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"))
    near = materialize(catalog._nearest(spark, folder, 10), "near")
    a, b = (metrics.report_by_category(catalog._scored(spark, folder, k, near), names).select("category", catalog._r("recall"), catalog._r("hit")) for k in (5, 10))
    return analysis.deltas(a, b, "category", ["recall", "hit"]).withColumn("delta", F.round("delta", 6))


@query("""WITH m AS (SELECT event_type AS model, count(*) AS n, round(avg(CAST(value > 50 AS INT)), 6) AS accuracy, round(avg(value), 6) AS speed FROM events GROUP BY event_type)
  SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, speed DESC, model) AS INT) AS place, accuracy = max(accuracy) OVER () AS most_accurate, speed = max(speed) OVER () AS fastest FROM m""")
def model_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers of models, their types as models' names."""
    runs = table(spark, folder, "events").select("event_type", (F.col("value") > 50).alias("good"), "value")
    return analysis.model_ranking(runs, "event_type", "good", "value").select("model", "n", catalog._r("accuracy"), catalog._r("speed"), "place", "most_accurate", "fastest")


@query("""WITH m AS (SELECT event_type AS model, round(avg(value), 6) AS speed FROM events GROUP BY event_type), f AS (SELECT *, first_value(speed) OVER (ORDER BY model) AS base FROM m)
  SELECT model, speed, round((speed - base) / base, 6) AS change FROM f""")
def model_changes(spark: SparkSession, folder: str) -> DataFrame:
    means = table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("speed"))
    return genmetrics.relative_change(means, "model", "speed").select("model", "speed", catalog._r("change"))


# --- an evaluation end to end: a stand-in search finds an item's passages from the second or third on


def _evaluated(k: int) -> str:
    near = f"near AS (SELECT item_id AS qid, item_id || '-' || (j + length(query) % 3) AS cid, j + 1 AS rank FROM (SELECT *, unnest(range({k})) AS j FROM asked))"
    qrels = "qrels AS (SELECT qid, cid, relevance FROM (SELECT item_id AS qid, item_id || '-' || i AS cid, CASE WHEN length(query) % 2 = 0 THEN i ELSE 1 END AS relevance FROM (SELECT item_id, query, unnest(range(len(relevant_texts))) AS i FROM asked)) WHERE relevance > 0)"
    asked = "asked AS (SELECT * FROM eval_items WHERE coalesce(answerable, true))"
    base = twins._metrics(k).replace(twins._near(k), f"{asked}, {near}").replace(twins._QRELS, qrels)
    return base.replace("v.vec_id", "v.item_id").replace("FROM embeddings v", "FROM asked v").replace(" WHERE v.item_id % 20 = 0)", ")")


_EVAL_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("precision", "recall", "hit", "rr", "ndcg", "ap"))


@query(" UNION ALL ".join(f"(SELECT 'v1' AS version, CAST({k} AS BIGINT) AS k, n, precision, recall, hit, rr, ndcg, ap FROM ({_evaluated(k)} SELECT count(*) AS n, {_EVAL_MEANS} FROM scored))" for k in (1, 3)))
def saved_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All items written, read, evaluated at two depths, and the reports saved and loaded."""
    path, reports_at = _folder(spark, "items"), _folder(spark, "metrics")
    stores.write_eval_items(_linked_items(spark, folder), path)
    tables = evaluating.evaluate(stores.read_eval_items(spark, path), _stand_in, (1, 3))
    evaluating.save_reports({"report": tables["report"]}, reports_at, {"depths": [1, 3]})
    out = evaluating.load_reports(spark, reports_at, "report")
    return out.select("version", "k", "n", *[catalog._r(m) for m in ("precision", "recall", "hit", "rr", "ndcg", "ap")])


def _stand_in(asked: DataFrame, k: int) -> DataFrame:
    places = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")
    return asked.select("qid", "query", places).select("qid", F.concat_ws("-", "qid", (F.col("j") + F.length("query") % 3).cast("string")).alias("cid"), (F.col("j") + 1).alias("rank"))


@query(" UNION ALL ".join(f"(SELECT {k} AS k, coalesce(nullif(d.category, ''), 'uncategorized') AS category, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM ({_evaluated(k)} SELECT * FROM scored) s LEFT JOIN eval_items d ON d.item_id = s.qid GROUP BY 2)" for k in (1, 3)))
def evaluation_by_category(spark: SparkSession, folder: str) -> DataFrame:
    items = _read_items(spark, folder)
    return evaluating.evaluate(items, _stand_in, (1, 3))["by_category"].select("k", "category", "n", catalog._r("hit"), catalog._r("recall"), catalog._r("rr"))


@query(" UNION ALL ".join(f"SELECT {k} AS k, item_id AS qid, CAST({k} AS BIGINT) AS retrieved, false AS passed FROM eval_items WHERE NOT coalesce(answerable, true)" for k in (1, 3)))
def evaluation_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    """Items that must find nothing; the stand-in finds something for each."""
    return evaluating.evaluate(_read_items(spark, folder), _stand_in, (1, 3))["guardrail"].select("k", "qid", "retrieved", "passed")


def _read_items(spark: SparkSession, folder: str) -> DataFrame:
    path = _folder(spark, "items")
    stores.write_eval_items(_linked_items(spark, folder), path)
    return stores.read_eval_items(spark, path)


@query("""WITH t AS (SELECT item_id, query, unnest(range(len(relevant_texts))) AS i FROM eval_items), p AS (SELECT item_id || '-' || (i - 1) AS cid, relevant_texts[i] AS text, source_breadcrumb AS source FROM (SELECT *, unnest(range(1, len(relevant_texts) + 1)) AS i FROM eval_items)),
  q AS (SELECT item_id AS qid, item_id || '-' || i AS cid, CAST(CASE WHEN length(query) % 2 = 0 THEN i ELSE 1 END AS INT) AS relevance FROM t WHERE length(query) % 2 = 1 OR i > 0)
  SELECT q.qid, q.cid, q.relevance, coalesce(CASE WHEN length(p.text) > 200 THEN substring(p.text, 1, 200) || '…' ELSE p.text END, '') AS preview, coalesce(p.source, '') AS source FROM q LEFT JOIN p ON p.cid = q.cid""")
def evaluation_details(spark: SparkSession, folder: str) -> DataFrame:
    """What the items should find, with the passages as stored chunks."""
    items = table(spark, folder, "eval_items")
    stored = items.select("item_id", F.col("source_breadcrumb").alias("source"), F.posexplode("relevant_texts").alias("i", "text")).select(F.concat_ws("-", "item_id", "i").alias("chunk_id"), "text", "source", F.lit(None).cast("int").alias("page"))
    read = _read_items(spark, folder)
    found = _stand_in(read.select(F.col("id").alias("qid"), "query"), 3).withColumn("score", F.lit(0.5))
    return evaluating.details(read, found, stored)["expected"].select("qid", "cid", "relevance", "preview", "source")


# --- generated sets, prompts, titles


def _tfidf(a: str, b: str) -> str:
    base = twins.sql()["tfidf_similarity"]
    first, second = base.split("coalesce(query, '')"), "coalesce(reference_answer, '')"
    return f"coalesce({a}, '')".join(part.replace(second, f"coalesce({b}, '')") for part in first)


@query(_tfidf("reference_answer", "query").replace("AS similarity", "AS relevance"))
def answer_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return genmetrics.similarity(table(spark, folder, "eval_items"), "item_id", "reference_answer", "query").select("item_id", F.round("similarity", 6).alias("relevance"))


@query(_tfidf("array_to_string(relevant_texts, ' ')", "query").replace("AS similarity", "AS relevance"))
def context_relevance(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", "query", F.array_join("relevant_texts", " ").alias("context"))
    return genmetrics.similarity(items, "item_id", "context", "query").select("item_id", F.round("similarity", 6).alias("relevance"))


@query("SELECT item_id, true AS within FROM eval_items")
def embedded_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the cosine of each pair's vectors lies within its bounds; the vectors are a model's, so SQL has no values for them."""
    scored = genmetrics.similarity(table(spark, folder, "eval_items"), "item_id", "query", "reference_answer", HashedEmbedding(64))
    return scored.select("item_id", F.col("similarity").between(-1.000001, 1.000001).alias("within"))


_CHUNKS = "c AS (SELECT chunk_id, min(text) AS text, min(unit) AS unit, min(chapter) AS chapter, min(page) AS page, min(breadcrumb) AS breadcrumb FROM chunks GROUP BY chunk_id)"


def _groups(size: int, n: int, seed: int, p: str) -> str:
    key = "unit, chapter"
    return f"""{p}long AS (SELECT * FROM c WHERE length(text) >= 200),
  {p}gap AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY {key} ORDER BY page NULLS LAST, chunk_id) > 6 THEN 1 ELSE 0 END AS gap FROM {p}long),
  {p}runs AS (SELECT *, sum(gap) OVER (PARTITION BY {key} ORDER BY page NULLS LAST, chunk_id ROWS UNBOUNDED PRECEDING) AS run FROM {p}gap),
  {p}cut AS (SELECT *, row_number() OVER (PARTITION BY {key}, run ORDER BY page NULLS LAST, chunk_id) - 1 AS i FROM {p}runs),
  {p}size AS (SELECT *, i // {size} AS g, count(*) OVER (PARTITION BY {key}, run, i // {size}) AS held, coalesce(max(page) OVER (PARTITION BY {key}, run, i // {size}) - min(page) OVER (PARTITION BY {key}, run, i // {size}), 0) AS wide FROM {p}cut),
  {p}fit AS (SELECT * FROM {p}size WHERE held = {size} AND (wide <= 6 OR {size} = 1)),
  {p}heads AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY run, g) AS turn FROM {p}fit WHERE i % {size} = 0),
  {p}taken AS (SELECT * FROM (SELECT unit AS u, chapter AS h, run AS r, g AS k, row_number() OVER (ORDER BY turn, md5('{seed}:' || concat_ws('|', coalesce(unit, ''), coalesce(chapter, ''))), unit NULLS FIRST, chapter NULLS FIRST) AS group_no FROM {p}heads) WHERE group_no <= {n}),
  {p}out AS (SELECT CAST(group_no AS INT) AS group_no, CAST(i % {size} + 1 AS INT) AS position, chunk_id, text, breadcrumb FROM {p}fit JOIN {p}taken ON unit IS NOT DISTINCT FROM u AND chapter IS NOT DISTINCT FROM h AND run = r AND g = k)"""


_SQL["chunk_groups"] = f"WITH {_CHUNKS}, {_groups(2, 40, 42, 'p')} SELECT group_no, position, chunk_id FROM pout"

_SYSTEM = "Faça uma pergunta."
NEGATIVES = ["Qual é a previsão do tempo para amanhã?", "Quem ganhou o jogo de ontem?"]


def _messages_sql(p: str, size: int) -> str:
    body = "min(text)" if size == 1 else "string_agg('TRECHO ' || position || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY position)"
    return f"""{p}ask AS (SELECT {size} AS family, group_no, {body} AS body, string_agg(chunk_id || ':3', ' ' ORDER BY position) AS linked, coalesce(max(CASE WHEN position = 1 THEN breadcrumb END), '') AS crumb FROM {p}out GROUP BY group_no)"""


_FAMILIES = f"WITH {_CHUNKS}, " + ", ".join(f"{_groups(s, n, 42 + s, f'f{s}')}, {_messages_sql(f'f{s}', s)}" for s, n in ((1, 100), (2, 30), (3, 20)))
_ASKED = " UNION ALL ".join(f"SELECT * FROM f{s}ask" for s in (1, 2, 3))
_PROMPT = f"'system: {_SYSTEM}' || chr(10) || chr(10) || 'user: ' || body"


@query(f"""{_FAMILIES}, asked AS ({_ASKED}), good AS (SELECT *, 'O que dizem os ' || length({_PROMPT}) || ' sinais?' AS query FROM asked WHERE length({_PROMPT}) % 7 <> 0),
  every AS (SELECT family, group_no, query, linked, CASE WHEN family = 1 THEN 'factual' ELSE 'multi_hop' END AS category, true AS answerable, family AS n_source_chunks, crumb AS source_breadcrumb FROM good
    UNION ALL SELECT 9, i, q, '', 'negative', false, NULL, '' FROM (SELECT unnest({twins._list(NEGATIVES)}) AS q, unnest(range({len(NEGATIVES)})) AS i))
  SELECT printf('q%04d', row_number() OVER (ORDER BY family, group_no) - 1) AS id, query, linked, category, answerable, CAST(n_source_chunks AS INT) AS n_source_chunks, source_breadcrumb FROM every""")
def generated_items(spark: SparkSession, folder: str) -> DataFrame:
    """Three families of questions about groups of chunks, and negatives, by a stand-in that counts what it is asked."""
    chunks = materialize(catalog._distinct_chunks(spark, folder), "chunks")
    made = datasets.generated_items(chunks, CountingQuestion(), NEGATIVES, system=_SYSTEM)
    linked = F.transform("relevant_chunks", lambda c: F.concat_ws(":", c["chunk_id"], c["relevance"].cast("string")))
    return made.withColumn("linked", F.array_join(linked, " ")).drop("relevant_chunks")


@query(f"""{_FAMILIES} SELECT group_no, linked, crumb AS breadcrumb, 'system' AS first_role, 'user' AS second_role, body AS content FROM f2ask""")
def question_prompts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = catalog._distinct_chunks(spark, folder)
    asked = datasets.question_prompts(chunks, sampling.chunk_groups(chunks, 2, 30, 44), _SYSTEM)
    linked = F.transform("chunk_ids", lambda c: F.concat(c, F.lit(":3")))
    m = F.col("messages")
    return asked.select("group_no", F.array_join(linked, " ").alias("linked"), "breadcrumb", m[0]["role"].alias("first_role"), m[1]["role"].alias("second_role"), m[1]["content"].alias("content"))


@query("""SELECT item_id, 1 AS n, 'user' AS role, 'Responda.' || chr(10) || chr(10) || query AS content FROM eval_items""")
def folded_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts for a model without a system role."""
    said = F.array(F.struct(F.lit("system").alias("role"), F.lit("Responda.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))
    folded = table(spark, folder, "eval_items").select("item_id", dialogue.fold_system(said).alias("m"))
    return folded.select("item_id", F.size("m").alias("n"), F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"))


@query(f"""{twins._MESSAGES}, f AS (SELECT session_id, min_by(content, turn) AS first FROM said GROUP BY session_id),
  g AS (SELECT session_id, first, CASE WHEN length(coalesce(first, '')) % 7 <> 0 THEN 'O que dizem os ' || length(coalesce(first, '')) || ' sinais?' ELSE '' END AS raw FROM f)
  SELECT session_id, CASE WHEN raw <> '' THEN raw ELSE {twins._title("first")} END AS title FROM g""")
def session_titles(spark: SparkSession, folder: str) -> DataFrame:
    """A title for each session by a model, its first message where the model gives none."""
    first = catalog._messages(spark, folder).groupBy("session_id").agg(F.min_by("content", "turn").alias("first"))
    return dialogue.with_titles(first, CountingQuestion(), "first").select("session_id", "title")


@query("SELECT item_id, answerable, lower(CAST(answerable AS VARCHAR)) AS said FROM eval_items")
def parsed_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags written as words and read back."""
    items = table(spark, folder, "eval_items").withColumn("said", F.col("answerable").cast("string"))
    word = F.when(F.col("answerable"), F.when(F.length("query") % 2 == 0, "Sim").otherwise(" yes ")).when(~F.col("answerable"), F.when(F.length("query") % 2 == 0, "off").otherwise("0"))
    return items.select("item_id", tx.parse_bool(word, None).alias("answerable"), "said")


# --- answers and events

_SQL["clean_answers"] = f"""WITH m AS (SELECT DISTINCT request_id, message, {twins._strip('message')} AS t FROM chat_requests),
  a AS (SELECT *, CASE WHEN lower(t) LIKE 'ok%' THEN trim(substring(t, 3), ' ' || chr(10) || chr(13) || chr(9) || ':-') ELSE t END AS said FROM m),
  q AS (SELECT *, list_filter(list_transform(regexp_split_to_array(message, '\\r\\n|[\\n\\r]'), lambda x, i: {twins._strip("CASE WHEN i = 1 THEN 'Pergunta: ' || x ELSE x END")}), lambda x: x <> '')[1] AS line FROM a),
  b AS (SELECT *, trim(regexp_replace(line, '(?i)^pergunta{twins._SPACE}*:?{twins._SPACE}*', ''), '"''“”‘’ ') AS asked FROM q)
  SELECT request_id, CASE WHEN message IS NULL OR said = '' OR {" OR ".join(f"starts_with(lower(said), '{p}')" for p in tx.PROMPT_ECHOES)} THEN '{tx.REFUSAL}' ELSE said END AS answer,
    CASE WHEN length(asked) >= 8 AND contains(asked, '?') THEN asked END AS question, {twins._any("lower(message)", tx.REFUSAL_MARKERS)} AS refused FROM b"""

_SQL["turn_events"] = r"""WITH t AS (SELECT DISTINCT CAST(request_id AS VARCHAR) AS session_id, coalesce(message, '') AS m FROM chat_requests),
  w AS (SELECT session_id, CASE WHEN m = '' THEN [''] ELSE regexp_extract_all(m, '^[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*') END AS words FROM t),
  e AS (SELECT session_id, list_concat(list_transform(words, lambda x: CAST(to_json({'type': 'token', 'text': x}) AS VARCHAR)), ['{"type":"done"}']) AS es FROM w)
  SELECT session_id, CAST(unnest(range(len(es))) AS INT) AS seq, unnest(es) AS event FROM e"""

_SQL["visible_tokens"] = f"""{twins._MESSAGES} SELECT session_id, CAST(turn AS BIGINT) AS seq, CASE WHEN turn % 5 IN (2, 3) THEN '' ELSE coalesce(content, '') END AS visible FROM said"""

_SQL["rouge"] = r"""WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(query, '')), '[\s\p{Z}]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(reference_answer, '')), '[\s\p{Z}]+'), lambda x: x <> '') AS b FROM eval_items),
  r AS (SELECT item_id, a, b, 0 AS i, list_transform(b, lambda x: 0) AS best FROM w
    UNION ALL SELECT item_id, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN 1 + CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END ELSE best[k] END))) FROM r WHERE i < len(a)),
  n AS (SELECT item_id, len(a) AS la, len(b) AS lb, coalesce(list_max(best), 0) AS n FROM r WHERE i = len(a)),
  s AS (SELECT item_id, CASE WHEN n > 0 THEN n / la ELSE 0 END AS p, CASE WHEN n > 0 THEN n / lb ELSE 0 END AS c FROM n)
  SELECT item_id, CAST(p AS DOUBLE) AS precision, CAST(c AS DOUBLE) AS recall, CAST(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END AS DOUBLE) AS f1 FROM s"""

_SQL["merged_sections"] = twins._SECTIONS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
  counted AS (SELECT *, len({twins._words('text')}) AS words, row_number() OVER (PARTITION BY source, document ORDER BY section_no) AS i,
    CASE WHEN topic IS NOT NULL THEN 3 WHEN chapter IS NOT NULL THEN 2 WHEN unit IS NOT NULL THEN 1 ELSE 0 END AS level FROM named WHERE text <> ''),
  keyed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST, document NULLS FIRST) AS book FROM counted),
  fold AS (SELECT book, i, section_no AS first, words FROM keyed WHERE i = 1
    UNION ALL SELECT k.book, k.i, CASE WHEN greatest(1, CAST(floor(f.words * CAST(1.33 AS DOUBLE)) AS INT)) < 200 THEN f.first ELSE k.section_no END, CASE WHEN greatest(1, CAST(floor(f.words * CAST(1.33 AS DOUBLE)) AS INT)) < 200 THEN f.words + k.words ELSE k.words END
    FROM fold f JOIN keyed k ON k.book = f.book AND k.i = f.i + 1),
  told AS (SELECT k.*, f.first FROM keyed k JOIN fold f ON f.book = k.book AND f.i = k.i)
  SELECT max(source) AS source, max(document) AS document, first AS section, min_by(page, i) FILTER (section_no = first) AS page, max(unit) FILTER (section_no = first) AS unit, max(chapter) FILTER (section_no = first) AS chapter,
    max(topic) FILTER (section_no = first) AS topic, max(level) FILTER (section_no = first) AS level, md5(string_agg(text, chr(10) || chr(10) ORDER BY section_no)) AS text_md5 FROM told GROUP BY book, first"""

_SENTENCE = twins.sql()["query_sentences"].replace("FROM documents)", "FROM d30)").replace("FROM documents d", "FROM d30 d")
_SQL["synthetic_items"] = (
    f"WITH {_CHUNKS.replace('c AS', 'ch AS', 1)}, d30 AS (SELECT chunk_id AS doc_id, text, breadcrumb FROM ch WHERE chunk_id IS NOT NULL AND regexp_matches(text, '[^\\s\\p{{Z}}]') ORDER BY md5('42:' || chunk_id), chunk_id LIMIT 30), sent AS ({_SENTENCE}), "
    + twins.sql()["top_keywords"].replace("WITH w AS", "w AS", 1).replace("FROM documents)", "FROM d30)").replace("SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM (", "").split(" SELECT doc_id, rank, word, times FROM r")[0]
    + """, k AS (SELECT doc_id, list(word ORDER BY rank) AS kw FROM r WHERE rank <= 3 GROUP BY doc_id),
  f AS (SELECT d.doc_id, CASE WHEN coalesce(len(kw), 0) = 0 THEN '' WHEN coalesce(breadcrumb, '') <> '' THEN 'O que o material diz sobre ' || array_to_string(kw[1:2], ' e ') || ' em: ' || breadcrumb || '?'
    WHEN len(kw) >= 2 THEN 'Explique a relação entre ' || kw[1] || ' e ' || kw[2] || '.' ELSE 'O que é ' || kw[1] || '?' END AS fallback FROM d30 d LEFT JOIN k ON k.doc_id = d.doc_id)
  SELECT f.doc_id AS chunk_id, coalesce(s.sentence, f.fallback) AS query FROM f LEFT JOIN sent s ON s.doc_id = f.doc_id WHERE coalesce(s.sentence, f.fallback) <> ''"""
)


def _estimate(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(floor(len({twins._words(x)}) * CAST(1.33 AS DOUBLE)) AS INT)) END"


_LEAST, _MOST, _SHARED = 200, 375, 50
_CUT = rf"regexp_replace({twins._strip('para')}, '([.!?…]){twins._SPACE}+([{twins._UPPER}\"(])', '\1' || chr(30) || '\2', 'g')"
_TEXT_CHAPTER = rf"nullif({twins._strip(rf"regexp_extract(substring(text, 1, 200), '(?i)cap(?:ítulo)?\.?{twins._SPACE}+(\d+|[IVX]+)')")}, '')"
_TEXT_TOPIC = rf"list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: {twins._strip('x')}), lambda x: length(x) BETWEEN 10 AND 80 AND NOT regexp_matches(x, '[.!?]$'))[1]"
_FOLDED = "len(list_filter(range(1, len(sizes) + 1), lambda k: list_sum(sizes[len(sizes) - k + 1:len(sizes)]) <= {0}))".replace("{0}", str(_SHARED))
# sentences are packed step by step, then neighbouring pieces are merged step by step
_SQL["chunked_documents"] = rf"""WITH RECURSIVE cleaned AS MATERIALIZED ({twins.sql()['page_texts']}),
  whole AS MATERIALIZED (SELECT doc_id, clean, {_estimate('clean')} AS own FROM cleaned WHERE clean <> ''),
  paras AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(clean, '\n\n+', chr(30), 'g'), chr(30)), lambda p: {twins._strip('p')}), lambda p: p <> '')) AS para, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(clean, '\n\n+', chr(30), 'g'), chr(30)), lambda p: {twins._strip('p')}), lambda p: p <> ''), 1) AS n FROM whole WHERE own > {_MOST})),
  lists AS MATERIALIZED (SELECT doc_id, n, list_filter(list_transform(string_split({_CUT}, chr(30)), lambda x: {twins._strip('x')}), lambda x: x <> '') AS parts FROM paras WHERE {_estimate('para')} > {_MOST}),
  sentences AS MATERIALIZED (SELECT doc_id, n, i, part, {_estimate('part')} AS own, last FROM (SELECT doc_id, n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS last FROM lists)),
  fold AS (
    SELECT doc_id, n, 0 AS i, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS waiting, CAST([] AS INT[]) AS sizes, CAST(0 AS BIGINT) AS size FROM lists
    UNION ALL
    SELECT f.doc_id, f.n, s.i,
      CASE WHEN s.own > {_MOST} THEN list_concat(done, CASE WHEN len(waiting) > 0 THEN [array_to_string(waiting, ' ')] ELSE [] END, [s.part]) WHEN full_ THEN list_append(done, array_to_string(waiting, ' ')) ELSE done END,
      CASE WHEN s.own > {_MOST} THEN [] WHEN full_ THEN list_append(waiting[len(waiting) - kept + 1:len(waiting)], s.part) ELSE list_append(waiting, s.part) END,
      CASE WHEN s.own > {_MOST} THEN [] WHEN full_ THEN list_append(sizes[len(sizes) - kept + 1:len(sizes)], s.own) ELSE list_append(sizes, s.own) END,
      CASE WHEN s.own > {_MOST} THEN 0 WHEN full_ THEN CAST(list_sum(sizes[len(sizes) - kept + 1:len(sizes)]) AS BIGINT) + s.own ELSE size + s.own END
    FROM (SELECT f.*, greatest(1, {_FOLDED}) AS kept, s.own AS next_own, s.part AS next_part, s.i AS next_i, len(waiting) > 0 AND size + s.own > {_MOST} AND size >= {_LEAST} AS full_ FROM fold f JOIN sentences s ON s.doc_id = f.doc_id AND s.n = f.n AND s.i = f.i + 1) f
    JOIN sentences s ON s.doc_id = f.doc_id AND s.n = f.n AND s.i = f.next_i),
  packed AS (SELECT f.doc_id, f.n, CASE WHEN len(waiting) = 0 THEN done WHEN size < {_LEAST} AND len(done) > 0 THEN list_append(done[1:len(done) - 1], done[len(done)] || ' ' || array_to_string(waiting, ' ')) ELSE list_append(done, array_to_string(waiting, ' ')) END AS pieces
    FROM fold f JOIN lists l ON l.doc_id = f.doc_id AND l.n = f.n AND f.i = len(l.parts)
    UNION ALL SELECT doc_id, n, [para] FROM paras WHERE {_estimate('para')} <= {_MOST}),
  flat AS (SELECT doc_id, n, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM packed),
  found AS MATERIALIZED (SELECT doc_id, piece, {_estimate('piece')} AS own, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS i FROM flat UNION ALL SELECT doc_id, clean, own, 0 FROM whole WHERE own <= {_MOST}),
  merge_ AS (SELECT doc_id, i, i AS first, piece AS text, own FROM found WHERE i = 0
    UNION ALL SELECT m.doc_id, f.i, CASE WHEN joins THEN m.first ELSE f.i END, CASE WHEN joins THEN m.text || ' ' || f.piece ELSE f.piece END, CASE WHEN joins THEN {_estimate("m.text || ' ' || f.piece")} ELSE f.own END
    FROM (SELECT m.*, least(m.own, f.own) < {_LEAST} AND m.own + f.own <= {_MOST} AS joins FROM merge_ m JOIN found f ON f.doc_id = m.doc_id AND f.i = m.i + 1) m JOIN found f ON f.doc_id = m.doc_id AND f.i = m.i + 1),
  made AS (SELECT doc_id, first, max_by(text, i) AS text FROM merge_ GROUP BY doc_id, first)
  SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY first) - 1 AS INT) AS chunk_no, m.text, coalesce(d.source, 'desconhecido') AS source, d.page, d.section,
    substring(sha1(coalesce(d.source, 'desconhecido') || '::' || first || CASE WHEN d.page IS NULL THEN '' ELSE '::page' || d.page END), 1, 16) AS chunk_id,
    {_TEXT_CHAPTER.replace('text', 'm.text')} AS chapter, {_TEXT_TOPIC.replace('text', 'm.text')} AS topic, coalesce(nullif(d.section, ''), {_TEXT_TOPIC.replace('text', 'm.text')}) AS section_title, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS breadcrumb,
    {_estimate('m.text')} AS tokens FROM made m JOIN documents d ON d.doc_id = m.doc_id"""


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def approximate_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the exact neighbours."""
    exact = catalog._nearest(spark, folder, 10)
    met = vectors.recall(catalog.approximate_search(spark, folder), exact)
    return met.agg(F.count("*").alias("n_queries"), (F.sum("met") >= 0.9 * F.sum("wanted")).alias("enough"))


# --- turns answered end to end

_LATE, _CONTEXT = twins.sql()["history_context"].removeprefix(twins._MESSAGES).replace("FROM said)", "FROM hist)").rsplit("SELECT s.session_id,", 1)
_ASKED, _RELEVANT = twins.sql()["topical_relevance"].removeprefix(twins._CASCADE).rsplit("SELECT a.qid,", 1)
_USABLE = "usable0 AS" + twins.sql()["context_pack"].split("usable0 AS", 1)[1].rsplit(" SELECT * FROM packed", 1)[0].replace("round(score, 1) AS score", "score").replace("FROM absolute", "FROM final")
_ANSWERS = rf"""{twins._MESSAGES}, ends AS (SELECT session_id, max(turn) AS t FROM said GROUP BY session_id),
  hist AS (SELECT s.* FROM said s JOIN ends e ON e.session_id = s.session_id WHERE s.turn < e.t)
  {_LATE}, ctx AS (SELECT s.session_id, {_CONTEXT}),
  turns AS (SELECT s.request_id AS qid, s.session_id, s.content AS message, e.t - 1 AS earlier FROM said s JOIN ends e ON e.session_id = s.session_id AND e.t = s.turn WHERE regexp_matches(s.content, '{twins._NOT_SPACE}')),
  queries AS MATERIALIZED (SELECT t.*, CASE WHEN earlier >= 2 AND {twins._any('lower(message)', dialogue.FOLLOW_UPS)} AND coalesce(c.context, '') <> '' THEN message || ' ' || c.context ELSE message END AS query FROM turns t LEFT JOIN ctx c ON c.session_id = t.session_id),
  shelf AS (SELECT e.vec_id, e.embedding, d.text, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.text IS NOT NULL),
  near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM (SELECT q.qid, s.vec_id AS cid, CAST(s.embedding[length(q.query) % 64 + 1] AS DOUBLE) AS score, s.text, s.source FROM queries q, shelf s)),
  absolute AS (SELECT * FROM near WHERE rank <= 12 AND score >= 0.2),
  final AS MATERIALIZED (SELECT * FROM absolute WHERE rank <= 3)
  {_ASKED}, rel AS (SELECT a.qid, {_RELEVANT}), {_USABLE},
  block AS (SELECT qid, string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM packed GROUP BY qid),
  past AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS said FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS b FROM hist) WHERE b <= 8 AND content IS NOT NULL GROUP BY session_id),
  settled AS (SELECT q.*, f.n, f.best, CASE WHEN f.n IS NULL THEN 'nothing found' WHEN NOT coalesce(r.relevant, false) THEN 'off topic' ELSE 'answered' END AS status, {twins._strip("concat_ws(chr(10) || chr(10), b.block, coalesce(p.said, ''), q.message)")} AS prompt
    FROM queries q LEFT JOIN (SELECT qid, count(*) AS n, max(score) AS best FROM final GROUP BY qid) f ON f.qid = q.qid LEFT JOIN rel r ON r.qid = q.qid LEFT JOIN block b ON b.qid = q.qid LEFT JOIN past p ON p.session_id = q.session_id)
  SELECT qid, session_id, CASE WHEN status = 'answered' THEN {twins._strip("substring(string_split(prompt, '. ')[1], 1, 400)")} ELSE '{tx.REFUSAL}' END AS answer, CASE WHEN status <> 'answered' THEN '' WHEN best < 0.45 THEN 'low' WHEN best < 0.65 THEN 'medium' ELSE '' END AS notice,
    coalesce(n, 0) AS n_chunks, status FROM settled"""


@query(_ANSWERS)
def answered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last message of every session answered from the stored documents, the messages before it as its history."""
    said = materialize(catalog._messages(spark, folder), "said")
    ends = said.groupBy("session_id").agg(F.max("turn").alias("t"))
    placed = said.join(ends, "session_id")
    turns = placed.where(F.col("turn") == F.col("t")).where(F.col("content").rlike(tx.NOT_SPACE)).select(F.col("request_id").alias("qid"), "session_id", F.col("content").alias("message"))
    history = placed.where(F.col("turn") < F.col("t")).select("session_id", "turn", "role", "content")
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("vec_id"), "text", "source", F.lit(None).cast("string").alias("breadcrumb"))
    index = table(spark, folder, "embeddings").select("vec_id", "embedding").join(docs, "vec_id")
    plain = RetrievalConfig(top_k=3, min_score=0.2, adaptive_sigma=99.0, gap_filter=False, keyword_filter=False, lexical_weight=0.0)
    return answering.answer(turns, history, index, LengthEmbedding(64), FirstSentence(), plain)


# --- streams, run to the end of finished tables


@query(_SQL["turn_events"])
def streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all turns, written by a streaming query and read back."""
    path, turns = _folder(spark, "turns"), table(spark, folder, "chat_requests").select(F.col("request_id").cast("string").alias("session_id"), "message").distinct()
    turns.write.parquet(path)
    out = _folder(spark, "events")
    answered = lambda rows: rows.select("session_id", F.col("message").alias("answer"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error"))
    events.write_events(spark.readStream.schema(turns.schema).parquet(path), answered, out, _folder(spark, "progress"), until_done=True).awaitTermination()
    return spark.read.schema("session_id string, seq int, event string").json(out).select("session_id", "seq", "event")


@query(_SQL["visible_tokens"])
def streamed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The visible tokens of all sessions, fed to a stateful streaming query in two batches."""
    said, turn = F.coalesce("content", F.lit("")), F.col("turn") % 5
    token = F.when(turn == 2, F.concat(F.lit("<think>"), said)).when(turn == 4, F.concat(F.lit("x</think>"), said)).otherwise(said)
    tokens = materialize(catalog._messages(spark, folder).select("session_id", F.col("turn").cast("bigint").alias("seq"), token.alias("token")), "tokens")
    path, out = _folder(spark, "tokens"), _folder(spark, "visible")
    progress = _folder(spark, "progress")
    for part in (tokens.where("seq <= 3"), tokens.where("seq > 3")):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = thoughts.visible_stream(spark.readStream.schema(tokens.schema).parquet(path))
        stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("session_id string, seq bigint, visible string").parquet(out)


# --- styles, parameters, tables of text


@query("""WITH b AS (SELECT doc_id, unnest(bold_lines) AS b, generate_subscripts(bold_lines, 1) AS i FROM documents)
  SELECT 'd' || doc_id AS source, CAST(i AS INT) AS line_no, trim(b.text) AS text, i % 2 = 1 AS bold, b.size + 1 AS size FROM b WHERE b.text IS NOT NULL""")
def styled_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines put together from two spans each; every second one has a span that is not bold."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode("bold_lines").alias("p", "b")).where("b.text IS NOT NULL")
    half = (F.length("b.text") / 2).cast("int")
    first = F.struct(F.lit(0).alias("span_no"), F.substring(F.col("b.text"), F.lit(1), half).alias("text"), F.lit(16).alias("flags"), F.lit("Serif").alias("font"), F.col("b.size").alias("size"))
    other = F.struct(F.lit(1).alias("span_no"), F.substring(F.col("b.text"), half + 1, F.length("b.text")).alias("text"), F.lit(0).alias("flags"), F.when(F.col("p") % 2 == 0, "Serif Bold").otherwise("Serif").alias("font"), (F.col("b.size") + 1).alias("size"))
    spans = lines.select(F.concat(F.lit("d"), "doc_id").alias("source"), F.lit(1).alias("page"), (F.col("p") + 1).alias("line_no"), F.explode(F.array(first, other)).alias("s")).select("source", "page", "line_no", "s.*")
    return reports.styled_lines(spans).select("source", "line_no", "text", "bold", "size")


@query("""SELECT config_id, CAST(greatest(10, m // 2) AS INT) AS min_tokens, CAST(m AS INT) AS max_tokens, overlap_tokens FROM (SELECT *, greatest(30, least(min_tokens * 5 // 3, 375)) AS m FROM chunk_configs)""")
def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes in tokens derived from sizes in characters."""
    made = [(r.config_id, ChunkConfig.of_chars(r.min_tokens * 5, r.overlap_tokens)) for r in table(spark, folder, "chunk_configs").select("config_id", "min_tokens", "overlap_tokens").collect()]
    return spark.createDataFrame([(i, c.min_tokens, c.max_tokens, c.overlap_tokens) for i, c in made], "config_id int, min_tokens int, max_tokens int, overlap_tokens int")


@query(f"{twins._metrics(10)} SELECT CAST(row_number() OVER (ORDER BY round(recall, 6) DESC, qid) AS INT) AS place, qid, round(recall, 6) AS recall, round(rr, 6) AS rr, hit FROM scored")
def per_query_table(spark: SparkSession, folder: str) -> DataFrame:
    """All queries, the best recall first; an evaluation set is brought together by the constant window on purpose."""
    scored = catalog._scored(spark, folder).select("qid", catalog._r("recall"), catalog._r("rr"), "hit")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("recall"), "qid")))


@query(f"""{twins._CASCADE}, {twins._TRACE}, n AS (SELECT q.qid, q.query, s.stage_no, s.stage, count(t.cid) AS c FROM queries q CROSS JOIN (SELECT unnest(range({len(twins._STAGES)})) AS stage_no, unnest({twins._list(twins._STAGES)}) AS stage) s
    LEFT JOIN trace t ON t.qid = q.qid AND t.stage_no = s.stage_no GROUP BY ALL)
  SELECT qid, CAST(to_json({{'stages': list({{'stage': stage, 'count': c}} ORDER BY stage_no), 'final_count': max_by(c, stage_no)}}) AS VARCHAR) AS trace FROM n GROUP BY qid""")
def trace_json(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.trace_json(_trace(spark, folder), catalog._queries(spark, folder).select("qid"), cascade.STAGES)


@query(f"""{twins.sql()['prompt_statuses'].split(' SELECT a.qid, a.cid,')[0]}, r AS (SELECT a.qid, string_agg('[#' || a.rank || '] score=' || printf('%.3f', a.score) || ' ' || CASE WHEN length({twins._strip('a.text')}) < 80 AND usable THEN 'filtered'
      WHEN {twins._strip('a.text')} <> '' AND contains(coalesce(context, ''), {twins._strip('a.text')}) THEN 'in prompt' WHEN {twins._strip('a.text')} <> '' AND contains(coalesce(context, ''), substring({twins._strip('a.text')}, 1, 60)) THEN 'cut' ELSE 'out' END
      || ' (' || length({twins._strip('a.text')}) || ' chars) ' || coalesce(a.source, 'desconhecido'), chr(10) ORDER BY a.rank) AS body FROM absolute a JOIN u USING (qid) LEFT JOIN b USING (qid) WHERE a.text IS NOT NULL GROUP BY a.qid)
  SELECT q.qid, coalesce(q.query, '') || chr(10) || CASE WHEN r.body IS NULL THEN 'nothing found' ELSE r.body || chr(10) || 'on topic' END AS report FROM queries q LEFT JOIN r USING (qid)""")
def chunk_reports(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every candidate, as a text for each query; all topics count as met."""
    pool = cascade.absolute_filter(catalog._pool(spark, folder), catalog.CONFIG.min_score).where("text IS NOT NULL")
    asked = catalog._queries(spark, folder).select("qid", "query")
    return analysis.chunk_reports(pool, catalog.prompt_statuses(spark, folder), asked.select("qid", F.lit(True).alias("relevant")), asked)


def queries() -> dict[str, catalog.Query]:
    return dict(_REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
