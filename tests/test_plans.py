"""Indexing, answering and evaluating end to end with stand-in models."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.config import ChunkConfig, RetrievalConfig
from quillon.plans import answering, evaluating, indexing
from quillon.providers import FirstSentence, HashedEmbedding
from quillon.sources.stores import VectorIndex, read_eval_items

PAGES = [
    ("livro.txt", 1, "Capítulo 1: Plantas\nA fotossíntese transforma luz em energia química nas folhas verdes."),
    ("livro.txt", 2, "Capítulo 2: Rios\nO rio transporta sedimentos das montanhas até o oceano profundo."),
    ("outro.txt", None, "A revolução industrial mudou o trabalho nas fábricas inglesas."),
]
CONFIG = RetrievalConfig(top_k=2, min_score=0.05, adaptive_sigma=99.0, gap_filter=False)


def index_of(spark, path):
    pages = spark.createDataFrame(PAGES, "source string, page int, text string")
    index = VectorIndex(spark, str(path), "hashed")
    provider = HashedEmbedding(128)
    stats = indexing.build_index(pages, index, provider, ChunkConfig(min_tokens=1, max_tokens=60)).first()
    return index, provider, stats, pages


def test_index_and_answer(spark, tmp_path):
    index, provider, stats, pages = index_of(spark, tmp_path / "i")
    assert stats.n == index.size() == 3
    indexing.build_index(pages, index, provider, ChunkConfig(min_tokens=1, max_tokens=60))
    assert index.size() == 3
    rows = index.rows().withColumn("vec_id", F.row_number().over(Window.orderBy("text")).cast("bigint"))
    assert {r.chapter for r in rows.collect()} == {"Capítulo 1", "Capítulo 2", None}
    turns = spark.createDataFrame([(1, "s1", "Como a fotossíntese transforma luz em energia?"), (2, "s2", "receita bolo cenoura chocolate"), (3, "s3", "explique melhor")], "qid bigint, session_id string, message string")
    history = spark.createDataFrame([("s3", 1, "user", "oi"), ("s3", 2, "assistant", "Sobre a Fotossíntese das folhas verdes.")], "session_id string, turn int, role string, content string")
    got = {r.qid: r for r in answering.answer(turns, history, rows, provider, FirstSentence(), CONFIG).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].status == "answered" and got[1].n_chunks >= 1 and "fotossíntese" in got[1].answer
    assert got[2].status != "answered" and got[2].answer.startswith("Não consigo")


def test_settings_from_the_environment():
    got = RetrievalConfig.from_env({"TOP_K": "7", "MIN_SCORE": "0.4", "GAP_FILTER": "no", "OTHER": "x", "LEXICAL_WEIGHT": ""})
    assert (got.top_k, got.min_score, got.gap_filter, got.lexical_weight) == (7, 0.4, False, 0.40)


def test_evaluate_and_save(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps([{"id": "a", "query": "um", "category": "x", "relevant_chunks": [{"chunk_id": "c1", "relevance": 3}]}, {"id": "b", "query": "dois", "answerable": False}, {"id": "c", "query": " "}]))
    items = read_eval_items(spark, str(path))
    search = lambda q, k: q.where("query = 'um'").select("qid", F.lit("c1").alias("cid"), F.lit(1).alias("rank"))
    tables = evaluating.evaluate(items, search, (1, 5))
    assert [(r.k, r.n, r.recall) for r in tables["report"].orderBy("k").collect()] == [(1, 1, 1.0), (5, 1, 1.0)]
    assert {r.passed for r in tables["guardrail"].collect()} == {True}
    assert evaluating.save_reports(tables, str(tmp_path / "m"), {"a": 1}).endswith("/v1")
    assert evaluating.save_reports(tables, str(tmp_path / "m"), {}).endswith("/v2")
    assert {(r.version, r.k, r.recall) for r in evaluating.load_reports(spark, str(tmp_path / "m"), "report").collect()} == {(v, k, 1.0) for v in ("v1", "v2") for k in (1, 5)}
    assert json.loads((tmp_path / "m/v1/run_meta.json").read_text()) == {"a": 1}
